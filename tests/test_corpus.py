"""Sources, prompts, cleaning, chunks, retrieval, quality and token arrays."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumwright.functions import cleaning, packing, prompts, quality, similarity
from sumwright.functions.stem import stem
from sumwright.functions.text import WHITESPACE, squeeze, strip, words
from sumwright.operators import corpus, retrieve, sample, tokens
from sumwright.plans import workflows
from sumwright.sources import corpora, examples

EXAMPLES = [
    {
        "id": "x",
        "pre_text": ["a .", "b ."],
        "post_text": "c .",
        "table": [["", "2011"], ["revenue", "$ 1,153.7"]],
        "qa": {"question": "growth ?", "program": "subtract(5, 3), divide(#0, 3)", "exe_ans": 0.5},
    },
    {"id": "y", "table_ori": {"k": "v", "n": 3}, "qa": {"program": ["add", "(", "1", ",", "2", ")"], "exe_ans": "yes"}},
    {"table": [{"p": "1", "q": None}, "bare", 7]},
    {"id": "z", "table": "as text", "qa": None},
]


@pytest.mark.parametrize(
    ("layout", "named"), [(x, n) for x in examples.LAYOUTS[1:] for n in (x, "auto")]
)
def test_examples_and_prompts(spark, tmp_path, layout, named):
    text = {
        "list": json.dumps(EXAMPLES),
        "wrapped": json.dumps({"data": EXAMPLES}),
        "lines": "\n\n".join(json.dumps(e) for e in EXAMPLES) + "\n",
    }[layout]
    (tmp_path / "e.json").write_text(text)
    raw = examples.read_examples(spark, str(tmp_path / "e.json"), named)
    typed = {r.id: r for r in examples.typed_examples(raw).collect()}
    assert (typed["x"].pre, typed["x"].post, typed["x"].exe_ans) == ("a . b .", "c .", "0.5")
    assert typed["x"].table == EXAMPLES[0]["table"] and typed["y"].exe_ans == "yes"
    rendered = {r.id: r for r in workflows.prompts(raw, "infer", "<", ">").collect()}
    assert rendered["x"].program_text == "subtract(5, 3) divide(#0, 3)"
    assert rendered["y"].program_text == "add(1, 2)"
    assert "\n\nTable:\n | 2011\nrevenue | $ 1,153.7\n\nContext (after table):\nc .\n\n" in rendered["x"].prompt_text
    assert "\n\nTable:\nk: v\nn: 3\n\n" in rendered["y"].prompt_text
    assert "\n\nTable:\np: 1 | q: None\nbare\n7\n\n" in rendered[""].prompt_text
    assert "\n\nTable:\nas text\n\n" in rendered["z"].prompt_text
    assert rendered["x"].prompt_text.endswith("Question: growth ?\n\nProgram:>")
    assert "End with EOF." in rendered["x"].prompt_text


NASTY = [
    {"id": 'a"],[{"', "text": 'quote " and \\\\ and \\" , ] } [ {', "deep": [[1, [2, {"data": [3, "],"]}]], {}]},
    {"id": "", "text": "", "deep": []},
    {"id": "long", "text": "x, " * 30, "deep": [",", ",,", "\\", 'é"😀\n\t,']},
    {"data": [{"data": [1, 2]}], "id": "wrapped inside", "deep": None},
    {"id": "end\\", "n": [1.5, -2e9, True]},
]


@pytest.mark.parametrize("size", [61, 200, 10**7])
def test_lists_are_read_alike_whatever_the_splits(spark, tmp_path, size):
    for copies, name in ((1, "a"), (2, "b")):
        records = NASTY * copies
        text = {
            "list": json.dumps(records, ensure_ascii=name == "a", indent=2 if name == "a" else None),
            "wrapped": json.dumps({"first": [[1, "data"], {"data": [5]}], "data": records, "last": {"data": [6, "]"]}}, indent=1 if name == "b" else None),
            "lines": "\n\n".join(map(json.dumps, records)),
        }
        for layout, own in text.items():
            (tmp_path / layout).mkdir(exist_ok=True)
            (tmp_path / layout / f"{name}.json").write_text(own)
            (tmp_path / "all").mkdir(exist_ok=True)
            (tmp_path / "all" / f"{layout}-{name}.json").write_text(own)
    want = sorted(json.dumps(r) for r in NASTY * 3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for layout in ("list", "wrapped", "lines"):
            got = examples.read_records(spark, str(tmp_path / layout), layout)
            assert sorted(json.dumps(json.loads(r.record)) for r in got.collect()) == want
        if size > 100:
            got = examples.read_records(spark, str(tmp_path / "all"), "auto")
            assert sorted(json.dumps(json.loads(r.record)) for r in got.collect()) == sorted(want * 3)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("text, layout, want", [("[]", "auto", []), ("", "auto", []), (" [ ] ", "list", []), ('{"data": []}', "auto", []), ('{"other": [1]}', "auto", []), ("[1, [2], null]", "auto", ["1", "[2]", "null"]), ("[1]\n[2]", "auto", ["[1]", "[2]"]), ("\n1\n2\n", "auto", ["1", "2"]), ('{"a": 1}\n{"a": 2}', "auto", ['{"a": 1}', '{"a": 2}'])])
def test_small_lists(spark, tmp_path, text, layout, want):
    (tmp_path / "x.json").write_text(text)
    assert sorted(r.record for r in examples.read_records(spark, str(tmp_path), layout).collect()) == sorted(want)


def test_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(EXAMPLES[:1]))
    (tmp_path / "b.json").write_text("\n" + json.dumps(EXAMPLES[3]) + "\r\n \n" + json.dumps(EXAMPLES[1]))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    raw = examples.read_examples(spark, str(tmp_path), "auto")
    assert sorted(r.id for r in examples.typed_examples(raw).collect()) == ["x", "y", "z"]


def test_text_stays_text(spark):
    records = [
        {"id": "1", "pre_text": "[1] The company sold 5 .", "post_text": "[a] b", "table": '["x"] tail', "qa": {"program": "[add(1, 2)]"}},
        {"id": "2", "pre_text": ["[1] a", "b"], "table": ["[1]", ["[x]", True, None, 1.50, {"k": [1, "a'b"]}], {"z": False, "a": "[q]"}, 2, None]},
        {"id": "3", "pre_text": None, "table": {"z": [True, "x"], "a": None}},
        {"id": "4", "table": True},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    typed = {r.id: r for r in examples.typed_examples(raw).collect()}
    assert (typed["1"].pre, typed["1"].post, typed["2"].pre, typed["3"].pre) == ("[1] The company sold 5 .", "[a] b", "[1] a b", "")
    prompted = {r.id: r for r in workflows.prompts(raw).collect()}
    table = {i: r.prompt_text.split("\n\nTable:\n")[1].split("\n\nContext (after")[0] for i, r in prompted.items()}
    assert table["1"] == '["x"] tail' and table["4"] == ""
    assert table["2"].split("\n") == ["[1]", "[x] | True | None | 1.5 | " + str({"k": [1, "a'b"]}).replace("[1, \"a'b\"]", '[1,"a\'b"]'), "z: False | a: [q]", "2", "None"]
    assert table["3"] == "z: [True, 'x']\na: None"
    assert prompted["1"].program_text == "add(1, 2)"


def test_prepare_round_trip(spark, tmp_path):
    rows = [("a", "x y x", "add(1, 2)"), ("b", "y", ""), ("c", "", "z")]
    prompted = spark.createDataFrame(rows, "id string, prompt_text string, program_text string")
    packed = workflows.prepare(prompted).withColumn("split", F.lit("train"))
    examples.write_splits(packed, str(tmp_path / "s"))
    back = {r.id: r for r in examples.read_split(spark, str(tmp_path / "s"), "train").collect()}
    assert [len(back[i].input_ids) for i in "abc"] == [6, 2, 2]
    assert back["a"].labels[:3] == [-100] * 3 and back["a"].labels[3:] == back["a"].input_ids[3:]
    assert back["a"].input_ids[0] == back["a"].input_ids[2]
    types = examples.tensor_columns(packed).dtypes
    assert types == [("input_ids", "array<int>"), ("attention_mask", "array<tinyint>"), ("labels", "array<bigint>")]


def test_whitespace(one):
    odd = "".join(WHITESPACE) + "a" + " " + "b" + " "
    assert one(strip(F.col("v")), odd) == [odd.strip()]
    assert one(squeeze(F.col("v")), odd) == [" ".join(odd.split())]
    assert one(words(F.col("v"), lower=True), odd + "B", "") == [["a", "b", "b"], []]


def test_prompt_wording(one):
    """The whole wording, written out."""
    intro = (
        "You are a program synthesis model for financial question answering.\n"
        "Given the context (before/after text) and a table, write a reasoning Program as a sequence of operations.\n"
        "Each step must look like: op(arg1, arg2). "
    )
    rest = "Context (before table):\nA\n\nTable:\nT\n\nContext (after table):\nB\n\nQuestion: Q\n\nProgram:"
    parts = [F.lit(x) for x in "ABTQ"]
    train, infer = (one(prompts.user_prompt(*parts, wording=w), "x")[0] for w in ("train", "infer"))
    assert train == intro + "Use #k to reference the result of step k (starting at #0 after first step).\n\n" + rest
    assert infer == intro + "Use #k to reference prior step results (#0 is the first step's result). End with EOF.\n\n" + rest


def test_templates(one):
    assert one(prompts.qa_template(F.col("v"), F.lit(None)), "q") == ["### Question:\nq\n\n### Answer:\nNone"]
    text = one(prompts.answer_prompt(F.col("v"), F.lit("why?")), "chunk")[0]
    assert "Context:\n        chunk\n" in text and "Question:\n        why?\n" in text
    assert "Context:\n        chunk\n" in one(prompts.question_prompt(F.col("v")), "chunk")[0]


def test_cleaning(one):
    cases = {
        "Page 12 Intro": "intro",
        "SARB annual report\nbody": "body",
        "sum of R3.4 billion.": "sum of 3,400,000,000 ZA. ZAR",
        "r8.2 billion": "8,199,999,999 ZAR",
        "R 5 million and r2 trillion": "5,000,000 ZAR and 2,000,000,000,000 ZAR",
        "R100": "100 ZAR",
        "R1,250.50 now": "1,250.50 ZAR now",
        "last year.": "last yea. ZAR",
        "infla-\ntion": "inflation",
        "a\n\n\nb   c": "a\nb c",
        "© All Rights Reserved x": "x",
        "r1.2.3 million": "1.2.3 ZAR million",
    }
    assert one(cleaning.clean_text(F.col("v")), *cases) == list(cases.values())
    whole = cleaning.clean_text(F.col("v"), whole_amounts=True)
    assert one(whole, "last year.", "R1,250.50.") == ["last year.", "1,250.50 ZAR."]


def naive_chunks(text, size, overlap, separators):
    """Piece lists merged one by one."""
    separator = next(s for s in separators if s == "" or s in text)
    if separator == "":
        pieces = list(text)
    else:
        first, *others = text.split(separator)
        pieces = [p for p in [first, *[separator + o for o in others]] if p]
    deeper = separators[separators.index(separator) + 1 :]
    out, held = [], []

    def flush():
        window = []
        for piece in held:
            if window and sum(map(len, window)) + len(piece) > size:
                out.append("".join(window))
                while window and (
                    sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size
                ):
                    window.pop(0)
            window.append(piece)
        if window:
            out.append("".join(window))
        held.clear()

    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
        else:
            flush()
            out.extend(naive_chunks(piece, size, overlap, deeper))
    flush()
    return [c.strip() for c in out if c.strip()]


def test_recursive_chunks(spark):
    rng = random.Random(3)
    texts = [""]
    for _ in range(60):
        parts = ["".join(rng.choice("abcdef") for _ in range(rng.choice([1, 4, 9, 30, 260]))) for _ in range(rng.randint(1, 60))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "\n", "\n\n", "  "]) for p in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {}
    for r in corpus.chunk_recursive(docs).orderBy("doc_id", "chunk_no").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    for i, text in enumerate(texts):
        want = naive_chunks(text, 200, 50, corpus.SEPARATORS) if text else []
        assert found.get(i, []) == want
        assert all(len(c) <= 200 for c in want)


def test_fixed_chunks_and_collection(spark, tmp_path):
    text = "\n\U0001f600" + "".join(chr(97 + i % 26) for i in range(398))
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string")
    chunks = corpus.chunk_fixed(docs)
    assert [r.text for r in chunks.orderBy("chunk_no").collect()] == [text[0:200], text[150:350], text[300:]]
    path = str(tmp_path / "collection")
    for _ in range(2):
        corpora.upsert_records(corpus.chunk_records(chunks, source="report"), path)
    stored = corpora.read_records(spark, path)
    assert stored.columns == ["id", "text", "metadata"]
    assert stored.count() == 3 and stored.first().metadata == {"source": "report"}


def test_upsert_reads_and_writes_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "collection")
    rows = [(f"{i:02x}{j:04x}", f"text {i} {j}", None) for i in range(40) for j in range(3)]
    schema = "id string, text string, metadata map<string,string>"
    corpora.upsert_records(spark.createDataFrame(rows, schema), path)
    files = set((tmp_path / "collection").rglob("*.parquet"))
    for broken in (tmp_path / "collection").glob("part=0*/*.parquet"):
        broken.write_bytes(b"never read")  # parts that the next records do not touch
    corpora.upsert_records(spark.createDataFrame([*rows[120 - 9 :], ("27ffff", "new", None), ("ffff", "other", None)], schema), path)
    added = set((tmp_path / "collection").rglob("*.parquet")) - files
    assert sorted(f.parent.name for f in added) == ["part=27", "part=ff"]
    held = spark.read.parquet(path + "/part=[12f]*")
    assert held.count() == 24 * 3 + 2


def test_best_runs_are_kept_up_to_date(spark, tmp_path):
    rng, path, rows = random.Random(5), str(tmp_path / "metrics"), []
    for n in range(4):
        new = [(f"r{rng.randint(0, 9)}", rng.choice("abc"), rng.choice([rng.random(), 0.001, None])) for _ in range(20)]
        rows += new
        corpora.append_metrics(spark.createDataFrame(new, corpora.METRICS), path)
        if n == 1:
            continue  # two files at once
        got = corpora.refresh_best(spark, path, str(tmp_path / "state"))
        want = corpora.best_run(spark.createDataFrame(rows, corpora.METRICS))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = corpora.refresh_best(spark, path, str(tmp_path / "state"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert len(list((tmp_path / "state" / "best").glob("version=*"))) == 3


def test_one_id_spreads_over_many_tasks(spark):
    rows = [("" if i % 10 else f"own {i}", [1] * (i % 7 + 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, input_ids array<int>").withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    got = tokens.collate(df.repartition(7), "id", 16).collect()
    assert len(got) == 2000 and sorted(r.batch_no for r in got) == sorted(i // 16 for i in range(2000))
    for batch in (0, 60, 124):
        own = [r for r in got if r.batch_no == batch]
        assert {len(r.input_ids) for r in own} == {max(sum(r.attention_mask) for r in own)}
    placed = sample.with_position(df.withColumn("row", F.monotonically_increasing_id()), "id", 42, "row")
    ranges = placed.where("id = ''").select((F.col("position") * 4 / 2000).cast("int").alias("q")).distinct()
    assert ranges.count() == 4 and placed.select("position").distinct().count() == 2000


def test_pages(spark):
    rows = [(1, 2, "two"), (1, 1, "one"), (1, 3, ""), (2, 10, "x"), (2, 9, "w")]
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    got = {r.doc_id: r.text for r in corpus.assemble_pages(pages).collect()}
    assert got == {1: "one\ntwo\n", 2: "w\nx\n"}


def test_text_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Page 3 x\n\ny")
    (tmp_path / "b.pdf").write_text("no")
    texts = corpora.read_texts(spark, str(tmp_path))
    cleaned = texts.withColumn("text", cleaning.clean_text(F.col("text")))
    corpora.write_texts(cleaned, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.txt", "x\ny")]


def test_collection_workflow(spark):
    docs = spark.createDataFrame([(1, "Page 1 Revenue rose. " * 30)], "doc_id int, text string")
    records = workflows.build_collection(docs).collect()
    assert len(records) > 1 and all(len(r.text) <= 200 for r in records)


@pytest.mark.parametrize("per_cell, blocks", [(2048, {}), (3, {}), (10, {"corpus_block": 4, "query_block": 7})])
def test_nearest(spark, per_cell, blocks):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    vectors += [(100, vectors[5][1]), (101, [0.0] * 8), (102, None), (103, [math.nan] * 8)]
    df = spark.createDataFrame(vectors, "vec_id int, embedding array<double>").repartition(3)
    got = {}
    found, _ = retrieve.search(retrieve.cell_index(df, per_cell=per_cell), df, 3, skip_self=True, **blocks)
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id))

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for i, v in vectors[:-3]:
        others = [(-round(cos(v, w), 9), j) for j, w in vectors[:-3] if j != i]
        assert sorted(got[i]) == [(n + 1, j) for n, (_, j) in enumerate(sorted(others)[:3])]
    assert not {101, 102, 103} & set(got)


def test_nearest_skips_cells(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 32))
    points = middles[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) * 0.2
    points[7] = points[8]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 10 = 0")
    found, work = retrieve.search(retrieve.cell_index(df, per_cell=64), queries, 5)
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    for query, rows in itertools.groupby(sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])), lambda r: r.query_id):
        keys = np.round(units @ units[query], 9)
        assert [r.neighbour_id for r in rows] == np.lexsort((np.arange(3000), -keys))[:5].tolist()
    assert found.count() == 300 * 5 and work.first().pairs < 0.1 * 300 * 3000
    empty = df.limit(0)
    assert retrieve.nearest(empty, df).count() == retrieve.nearest(queries, empty).count() == 0


def test_similarity(one):
    value = similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    assert one(value, "x") == [pytest.approx(1 / math.sqrt(2))]
    terms = similarity.term_cosine(words(F.col("v")), words(F.lit("a b c d")))
    assert one(terms, "a b a x", "", "q") == [pytest.approx(2 / math.sqrt(12)), 0.0, 0.0]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def test_longest_common_subsequence(spark):
    rng = random.Random(2)
    rows = [
        ([rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(m)])
        for n, m in [(0, 0), (0, 4), (5, 0), (10, 62), (62, 10), (61, 300), (70, 63), (80, 90), (63, 62)]
    ]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", quality.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        assert r.n == lcs(r.a, r.b)


def test_scores(one):
    assert one(quality.rouge_l(F.col("v"), F.lit("The cat sat.")), "the CAT ran", "", "dog") == [
        pytest.approx(4 / 6), 0.0, 0.0,
    ]
    assert one(quality.reading_ease(F.col("v")), "The cat sat.", "") == [
        pytest.approx(206.835 - 1.015 * 3 - 84.6 * 1), 0.0,
    ]


def test_long_sides_are_fast(spark):
    rng = random.Random(7)
    a, b = ([rng.choice("abcdefgh") for _ in range(800)] for _ in range(2))
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    value = df.select(quality.rouge_l(F.col("a"), F.col("b")).alias("r")).first().r
    assert value == pytest.approx(2 * lcs(a, b) / 1600)


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("rational", "ration"), ("triplicate", "triplic"), ("hopeful", "hope"),
        ("revival", "reviv"), ("adoption", "adopt"), ("controlling", "control"), ("roll", "roll"),
        ("rate", "rate"), ("cease", "ceas"), ("generalizations", "gener"), ("oscillators", "oscil"),
    ],
)
def test_porter_stems(word, stemmed):
    assert stem(word) == stemmed


def test_stemmed_scores(one):
    value = quality.rouge_l(F.col("v"), F.lit("motors were running"), stemmed=True)
    assert one(value, "motoring runs", "the") == [pytest.approx(4 / 5), 0.0]


def test_gaps_and_ranges_of_turns(spark):
    rows = [(c, t * t, ("user", "assistant")[t % 2], f"{c}.{t}") for c in (1, 2, None) for t in range(40)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    pairs = corpus.conversation_pairs(turns.where("conv_id is not null").repartition(9)).collect()
    assert sorted((r.question, r.answer) for r in pairs) == sorted((f"{c}.{t}", f"{c}.{t + 1}") for c in (1, 2) for t in range(0, 40, 2))


def test_rows_stay_rows(spark):
    rows = [("", "a b", "x"), ("", "a c", "x"), ("k", "b b", "x y"), ("k", "b b", "x y"), (None, "", "")]
    prompted = spark.createDataFrame(rows, "id string, prompt_text string, program_text string")
    packed = workflows.prepare(prompted)
    assert packed.count() == 5
    assert all(min(r.input_ids) >= tokens.RESERVED for r in packed.collect())
    vocab = spark.createDataFrame([("a", 1, 2)], "term string, n int, token_id int")
    known = workflows.prepare(prompted, vocab).collect()
    assert sorted(i for r in known for i in r.input_ids) == [1] * 17 + [2] * 2
    batches = tokens.collate(packed, "id", 2).collect()
    assert len(batches) == 5 and sum(x == -100 for r in batches for x in r.labels) == sum(x == 0 for r in batches for x in r.attention_mask)


def test_repeated_documents_give_one_record(spark):
    docs = spark.createDataFrame([(1, "x" * 300), (1, "x" * 300), (2, "x" * 300)], "doc_id int, text string")
    records = corpus.chunk_records(corpus.chunk_fixed(docs))
    assert records.count() == 4 and records.select("id").distinct().count() == 4


def test_written_tables_can_be_deleted(spark):
    from sumwright.session import checkpointed, delete_written

    kept = checkpointed(spark.range(3))
    assert kept.count() == 3 and delete_written(spark) >= 1 and delete_written(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        kept.select("id").collect()


def test_package_goes_to_the_executors(spark):
    import zipfile

    from sumwright.session import ship

    from pyspark import SparkFiles

    ship(spark)
    assert "sumwright/operators/corpus.py" in zipfile.ZipFile(SparkFiles.get("sumwright.zip")).namelist()


def test_pairs(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (2, 0, "system", "s"), (2, 1, "assistant", "a"), (1, 3, "user", "q3")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    pairs = corpus.conversation_pairs(turns)
    assert [(r.question, r.answer, r.source) for r in pairs.collect()] == [("q1", "a1", "q1")]
    report = workflows.pair_report(workflows.pair_scores(pairs)).first()
    assert report.pairs == 1
    counts = corpus.term_counts(pairs, "answer", "question", F.lit("Q1"))
    assert {r.term: r.n for r in counts.collect()} == {"q1": 2, "a1": 1}
    assert corpus.top_terms(counts, 1).first().term == "q1"
    stats = corpus.term_stats(counts).first()
    assert (stats.unique_terms, stats.words) == (2, 3)


@pytest.mark.parametrize("parts", [1, 5])
def test_split_and_position(spark, parts):
    df = spark.range(1003).withColumnRenamed("id", "k").repartition(parts)
    split = sample.with_split(df, "k", 0.1, 42)
    test = {r.k for r in split.where("split = 'test'").collect()}
    assert len(test) == 101 and split.count() == 1003
    import hashlib

    order = sorted(range(1003), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert test == set(order[:101])
    placed = {r.k: r.position for r in sample.with_position(df, "k", 42).collect()}
    assert [placed[k] for k in order] == list(range(1003))
    assert [r.k for r in sample.first_rows(df, 3, F.desc("k")).collect()] == [1002, 1001, 1000]
    copies = df.select((F.col("k") % 4).alias("k"))
    sides = sample.with_split(copies, "k", 0.3).groupBy("k").agg(F.count_distinct("split").alias("n"))
    assert {r.n for r in sides.collect()} == {1}
    tested = sample.with_split(copies, "k", 0.3).where("split = 'test'").count()
    assert 301 <= tested < 301 + 251
    for fraction, size in ((0.0, 0), (1.0, 1003)):
        assert sample.with_split(df, "k", fraction).where("split = 'test'").count() == size


def test_vocabulary_and_encoding(spark):
    long_word = "w" * 200
    rows = [(1, ["b", "a", "b", long_word]), (2, []), (3, ["zz", "b", "?"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    counts = df.select(F.explode("t").alias("term")).where("term <> '?'").groupBy("term").agg(F.count("*").alias("n"))
    vocab = tokens.build_vocab(counts, reserved=1)
    ids = {r.term: r.token_id for r in vocab.collect()}
    assert sorted(ids.values()) == [1, 2, 3, 4] and ids["b"] == 1
    for head in (50_000, 1, 0):
        out = tokens.encode(df, "id", F.col("t"), vocab, unknown=9, reserved=1, head=head)
        got = {r.id: r.ids for r in out.collect()}
        assert got == {i: [ids.get(t, 9) for t in t_list] for i, t_list in rows}


def test_packing(spark, one):
    pack = packing.pack(F.array(F.lit(7), F.lit(8)), F.array(F.lit(9)))
    row = one(pack, "x")[0]
    assert (row.input_ids, row.attention_mask, row.labels) == ([7, 8, 9], [1, 1, 1], [-100, -100, 9])
    assert one(packing.target_text(F.col("v")), " add(1, 2) ", "") == ["add(1, 2) EOF", "EOF"]
    padded = one(packing.pad(F.array(F.lit(7), F.lit(8)), 3), "x")[0]
    assert (padded.input_ids, padded.attention_mask) == ([7, 8, 0], [1, 1, 0])
    assert one(packing.pad(F.array(F.lit(7), F.lit(8)), 1), "x")[0].input_ids == [7]
    rows = [(i, list(range(1, i + 2)), [1] * (i + 1)) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, attention_mask array<tinyint>")
    batches = tokens.collate(df, "id", 2).collect()
    for r in batches:
        mates = [b for b in batches if b.batch_no == r.batch_no]
        assert len(mates) in (1, 2) and len(r.input_ids) == max(m.id for m in mates) + 1
        assert sum(r.attention_mask) == r.id + 1
        assert r.labels == [x if x else -100 for x in r.input_ids]


def test_token_checks(spark):
    rows = [
        (1, [0, 9], [-100, 9], "train"),
        (2, [10, -1], [-100, -5], "train"),
        (3, [1], [10], "dev"),
        (4, [1], [-5], "dev"),
    ]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, labels array<bigint>, split string")
    bad = {r.id: (r.bad_inputs, r.bad_labels) for r in tokens.find_bad_tokens(df, 10).collect()}
    assert bad == {2: ([10, -1], []), 3: ([], [10])}
    assert {r.id for r in tokens.find_bad_tokens(df, 10, strict=True).collect()} == {2, 3, 4}
    report = {r.split: (r.rows, r.issues, r.first_bad, r.passed) for r in tokens.token_report(df, 10).collect()}
    assert report == {"train": (2, 1, [2], False), "dev": (2, 1, [3], False)}
    assert [r.id for r in tokens.issue_sample(df, 10, rows=1).collect()] == [2]


def test_run_metrics(spark, tmp_path):
    for run, loss in (("r1", 2.0), ("r2", 1.5)):
        folder = tmp_path / run
        folder.mkdir()
        (folder / "summary.json").write_text(json.dumps({"eval/loss": loss, "_x": {"n": 1}}))
    metrics = corpora.read_run_summaries(spark, str(tmp_path / "*/summary.json"), r"/([^/]+)/[^/]+$")
    corpora.append_metrics(metrics, str(tmp_path / "metrics"))
    stored = spark.read.parquet(str(tmp_path / "metrics"))
    assert [tuple(r) for r in corpora.best_run(stored, "eval/loss").collect()] == [("eval/loss", "r2", 1.5)]
    assert corpora.best_run(stored, smaller_is_better=False).first().run_id == "r1"
