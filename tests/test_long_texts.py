"""Documents in parts against the cut of their whole text."""

import random

import pytest
from pyspark.sql import functions as F

from sumwright.operators import corpus, long_texts
from sumwright.plans.catalog import QUERIES


def random_text(rng):
    words = ["".join(rng.choice("abé\U0001f600") for _ in range(rng.choice([1, 3, 8, 25]))) for _ in range(rng.randint(0, 40))]
    return "".join(w + rng.choice([" ", " ", "\n", "\n\n", "\n\n\n", "   ", "\t"]) for w in words)


def in_parts(rng, text, most):
    parts, at = [], 0
    while at < len(text):
        n = rng.randint(1, most)
        parts.append(text[at : at + n])
        at += n
    return parts


@pytest.mark.parametrize("block", [1, 7, 50, 1000])
def test_blocks_alone(block):
    """Functions of blocks composed one by one lead to the same chunks, whatever their size."""
    rng, size, overlap = random.Random(block), 20, 5
    special = ["\n" * 95, "a" * 90, " " * 70 + "b", "\n\n", "x\n" * 60, "a" + "\n" * 61 + "b c", "\n" * 41 + "abc " * 20]
    for text in special + [random_text(rng) for _ in range(60)]:
        state, found = 0, []
        for b in range(-(-len(text) // block)):
            whole = text[max(b * block - size, 0) : (b + 1) * block + 4 * size]
            cut = long_texts.Cut(whole, b, state >= size, size, overlap, block)
            inside = list(cut.chunks(state % size))
            to, n = cut.function(size)
            assert n[state % size] == len(inside)
            found += inside
            state = int(to[state % size]) + size * cut.odd_next
        assert found == corpus.split_text(text, size, overlap), repr(text)


@pytest.mark.parametrize(("block", "most"), [(30, 11), (400, 90), (2**18, 3)])
def test_chunks_of_parts(spark, monkeypatch, block, most):
    monkeypatch.setattr(long_texts, "GROUP", 3)
    rng = random.Random(block)
    texts = {i: "".join(random_text(rng) for _ in range(1 + 3 * (i == 0))) for i in range(12)} | {None: "a b\n" * 30, 99: "\n" * 200 + "end"}
    rows = [(i, n, p, "extra") for i, t in texts.items() for n, p in enumerate(in_parts(rng, t, most))]
    rows += [(0, 10**6, None, "x"), (1, -5, "", "x"), (98, 0, "", "x"), (97, 0, None, "x")]
    rng.shuffle(rows)
    parts = spark.createDataFrame(rows, "doc_id int, part_no int, text string, block string")
    found = {}
    for r in long_texts.chunk_parts(parts, size=20, overlap=5, block=block).orderBy("doc_id", "chunk_no").collect():
        assert r.chunk_no == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].append(r.text)
    assert found == {i: c for i, t in texts.items() if (c := corpus.split_text(t, 20, 5))}


def test_no_parts_and_bad_sizes(spark):
    parts = spark.createDataFrame([], "doc_id string, part_no int, text string")
    empty = long_texts.chunk_parts(parts)
    assert empty.columns == ["doc_id", "chunk_no", "text"] and empty.count() == 0
    with pytest.raises(ValueError):
        long_texts.chunk_parts(parts, size=10, overlap=10)


def test_one_document_in_many_blocks(spark):
    """A document of which no task holds more than a block."""
    text = " ".join(f"word{i}" + "\n" * (i % 17 == 0) * (i % 3) for i in range(20_000))
    parts = spark.range(1).select(F.lit("d").alias("doc_id"), F.posexplode(F.array(*[F.lit(text[i : i + 9999]) for i in range(0, len(text), 9999)])).alias("part_no", "text"))
    chunks = long_texts.chunk_parts(parts, block=4096).orderBy("chunk_no").collect()
    assert [c.text for c in chunks] == corpus.split_text(text)
    placed = long_texts.with_offsets(parts, "doc_id", "part_no", "text")
    held = long_texts.blocks(placed, 4096, 200, 800).agg(F.max(F.length("text")), F.count("*")).first()
    assert held[0] == 4096 + 1000 and held[1] == -(-len(text) // 4096)


def test_chunks_of_sources(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), random_text(rng) * 20 if i % 9 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id int, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in QUERIES["chunk_sources"](spark, str(tmp_path)).orderBy("source", "chunk_no").collect():
        found.setdefault(r.source, []).append(r.text)
    assert found == {s: corpus.split_text("".join(t or "" for _, x, t in rows if x == s)) for s in ("a", "b", None)}
