import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from sumwright.llm import mixing
from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
MENU = "home about contact"


def corpus():
    """Documents with toxic terms, one line that half of a source shares, copies and benchmark items."""
    rng = random.Random(6)
    words = [a + b + c for a in "badukelomino" for b in ("ran", "til", "sop") for c in "aeiou"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(15)) for i in range(4)]
    docs, labels = [], []
    for i in range(400):
        own = text(rng.choice([30, 60, 200]))
        toxic = i % 8 == 0
        if toxic:
            own = own.replace(" ", " grubsch ", 2)
        elif i % 8 == 1:
            own += "\n" + MENU
        elif i % 40 == 2:
            own += " " + items[i % 4][1].title()
        docs.append((i, own, "en", f"src{i % 3}"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    for i in range(400, 430):  # copies, exact and with other blanks
        docs.append((i, docs[i % 5 + 3][1].replace(" ", "  " if i % 2 else " "), "en", "src1"))
    docs += [(900, None, "en", None), (901, "", None, "src0"), (902, "!", "en", "src2")]
    return [(*d[:2], *d[2:], len(d[1] or "")) for d in docs], labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = corpus()
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs, _, items = corpus()
    want = {d: (t, s) for d, t, _, s, _ in docs if "grubsch" not in (t or "")}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal frame
        frame = stages[name](spark, frame, folder)
        path = f"{folder}/after-{name}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        if name != "mix_sources":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return frame.collect()

    assert {r.doc_id for r in run("toxicity")} == set(want)
    found = {r.doc_id: r for r in run("line_dedup")}
    for i, (text, source) in want.items():
        rest = text if text is None else "\n".join(x for x in text.split("\n") if x != MENU)
        assert (found[i].text, found[i].source) == (rest, source)
        assert found[i].n_chars == (None if rest is None else len(rest))
    assert any(MENU in (t or "") for t, _ in want.values())
    rows = [(i, found[i].text) for i in want]
    top = brute.components([(i, brute.simhash(t)) for i, t in rows])
    assert {r.doc_id for r in run("near_dedup")} == set(top) and len(set(top)) < len(rows) - 25
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    clean = {i for i, (_, hit, _) in brute.contamination(rows, items).items() if not hit}
    assert {r.doc_id for r in run("decontaminate")} == clean and len(clean) < len(rows)
    plan = {r.doc_id: r.copies for r in mixing.plan(frame).collect()}
    mixed = run("mix_sources")
    assert Counter(r.doc_id for r in mixed) == +Counter(plan)
    assert all(r["copy"] in range(1, 4) for r in mixed)


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[-1] == "copy" and 0 < got.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.parquet(f"{folder}/after-mix_sources").collect()))


def test_empty_documents(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCUMENTS), folder).count() == 0


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "sumwright").mkdir()
    for part in root.joinpath("sumwright").iterdir():
        if part.name != "llm":
            (tmp_path / "sumwright" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, ''); import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[1:] == ["False", "False", "True"], done.stderr
