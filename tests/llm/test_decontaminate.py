import random

import pyarrow as pa
import pytest

from sumwright.llm import decontaminate
from tests.llm import brute

DOCS = "doc_id long, text string, spans string, row string, n_words string"
ITEMS = "item_id long, text string, doc_id string"


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "own", "own", "own") for d in docs], DOCS),
        spark.createDataFrame([(*i, "own") for i in items], ITEMS),
    )


def corpus(seed, vocabulary=12):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "ßx", "a1", "12"] + [f"w{i}" for i in range(vocabulary)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", "\x7f"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 9, 10, 11, 25]))) for i in range(25)] + [(3, "the Of é"), (77, None), (78, "...")]
    docs = [(i, text(rng.choice([0, 1, 8, 30, 200]))) for i in range(60)]
    docs += [(100 + i, text(20) + (items[i][1] or "").upper() + text(5)) for i in range(25)]
    docs += [(200, None), (201, ""), (202, "!?"), (203, text(40_000))]
    return docs, items


@pytest.mark.parametrize("vocabulary", [3, 400])
def test_against_brute_force(spark, vocabulary):
    docs, items = corpus(vocabulary, vocabulary)
    got = decontaminate.contamination(*tables(spark, docs, items)).collect()
    want = brute.contamination(docs, items)
    assert len(got) == len(docs)
    for r in got:
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, names, len(names), hit > 0)


def test_blocks_of_items_and_small_shards_give_the_same(spark, monkeypatch):
    docs, items = corpus(5)
    whole = {r.doc_id: r for r in decontaminate.contamination(*tables(spark, docs, items)).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 7)
    for r in decontaminate.contamination(*tables(spark, docs, items)).collect():
        assert r == whole[r.doc_id]


def test_words_are_split_as_characters_are():
    texts = ["Aa-Zz09", None, "", "é\x7fÉ_ß", "日本 x", "\x80a b"]
    words, counts = decontaminate.words_of(pa.array(texts))
    assert [w.decode() for w in words.to_pylist()] == [w for t in texts for w in brute.item_words(t)]
    assert counts.tolist() == [len(brute.item_words(t)) for t in texts]


def test_spans_and_proximity(spark):
    docs = [(1, "x red green blue y"), (2, "red or green and blue"), (3, "red a b green blue"), (4, "blue green red"), (5, "red green red a green blue")]
    found = decontaminate.matches(*tables(spark, docs, [(7, "Red green, blue")]), slack=1).collect()
    spans = {r.doc_id: [(s.start, s.end, s.item_id, s.exact) for s in r.spans] for r in found}
    assert spans == {
        1: [(1, 4, "7", True)],
        2: [(0, 5, "7", False)],
        3: [],
        4: [],
        5: [(2, 6, "7", False)],
    }


def test_proximity_against_brute_force(spark):
    docs, items = corpus(8, 4)
    docs = [d for d in docs if d[0] != 203]
    slack, window = 2, 3
    found = decontaminate.matches(*tables(spark, docs, items), window=window, slack=slack).collect()
    texts = dict(docs)
    for r in found:
        w, want = brute.item_words(texts[r.doc_id]), set()
        for item, text in items:
            own = brute.item_words(text)
            for i in range(max(len(own) - window + 1, min(len(own), 1))):
                phrase, reach = own[i : i + window], {}
                for p, x in enumerate(w):
                    if x == phrase[0]:
                        reach[p] = p
                for t in phrase[1:]:
                    reach = {p: max(reach[q] for q in range(p - slack - 1, p) if q in reach) for p, x in enumerate(w) if x == t and any(q in reach for q in range(p - slack - 1, p))}
                want |= {(a, p + 1, str(item)) for p, a in reach.items() if p + 1 - a > len(phrase)}
        assert {(s.start, s.end, s.item_id) for s in r.spans if not s.exact} == want


def test_contaminated_rows_go(spark):
    docs = [(1, "clean text"), (1, "red green blue"), (None, "a red green blue"), (2, None), (3, "")]
    source, items = tables(spark, docs, [(7, "red green blue"), (None, "also this")])
    kept = decontaminate.drop_contaminated(source, items)
    assert kept.columns == source.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "clean text"), (2, None), (3, "")], key=str)


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [])
    assert [tuple(r) for r in decontaminate.contamination(docs, items).collect()] == [(1, 2, 0, 0, [], False)]
    assert decontaminate.contamination(*tables(spark, [], [(1, "a")])).count() == 0


def test_one_index_answers_any_benchmark(spark):
    from pyspark.sql import functions as F

    docs, items = corpus(6)
    built = decontaminate.build_index(tables(spark, docs, items)[0].repartition(25))
    assert built.count() > 20
    words = [w for _, t in docs for w in brute.item_words(t)]
    assert built.agg(F.sum(F.size("places"))).first()[0] == len(words)  # of all terms, whatever a benchmark asks for
    for benchmark in (items, [(1, "Of the é ßx"), (2, "w1 w2")], [(5, "nothing of this kind occurs")]):
        want = brute.contamination(docs, benchmark)
        asked = spark.createDataFrame([(*i, "own") for i in benchmark], ITEMS)
        for r in decontaminate.ask(built, asked).collect():
            hit = {i for s in r.spans for i in range(s.start, s.end)}
            assert (r.n_words, len(hit), sorted({s.item_id for s in r.spans})) == want[r.doc_id]
