import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sumwright.llm import queries, suffix_dedup

SCHEMA = "doc_id long, text string, kept string, core string"


def brute(rows, length=100):
    """``(id, n_bytes, spans, kept)`` of rows ``(id, text)``; equal rows are one document."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, found = set(), {}
    for none, doc, text in order:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        found[none, doc, text] = (len(data), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return [(d, *found[d is None, d or 0, t or ""]) for d, t in rows]


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    words = [a + b + c for a in "badukelo" for b in ("ran", "til", "é", "sop") for c in "aeiou"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    line, rows = text(30), []
    ids = rng.sample(range(-1000, 1000), n)
    for doc in ids:
        kind, own = rng.random(), text(rng.choice([3, 20, 60, 200]))
        if rows and kind < 0.3:  # a near copy with some words changed
            own = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            own = " ".join(own)
        elif kind < 0.5:
            own = f"{own}\n{line}\n{text(rng.choice([1, 40]))}"
        elif kind < 0.6:
            own = own[: rng.randint(1, 50)] * rng.randint(2, 30)
        elif kind < 0.7 and rows:
            other = rng.choice(rows)[1] or ""
            at = rng.randrange(len(other) + 1)
            own += other[at : at + rng.choice([99, 100, 101, 130])]
        rows.append((doc, own))
    rows += [(5000, None), (5001, ""), (5002, "a" * 99), (5003, "a" * 100), (5004, "a" * 400), (5005, "ab" * 300)]
    return [r for r in rows if r[0] is not None]


@pytest.mark.parametrize("length, block", [(100, 48 * 1024), (100, 512), (33, 700)])
def test_rows_against_brute_force(spark, monkeypatch, length, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = corpus(length + block)
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(5)
    got = suffix_dedup.drop_repeats(docs, length)
    assert got.columns == ["doc_id", "text", "kept", "core", "n_bytes", "removed"]
    found = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got.collect()]
    assert sorted(found) == sorted(brute(rows, length))
    assert sum(bool(r[2]) for r in found) > 30


def test_repeated_and_missing_ids(spark):
    rng = random.Random(4)
    text = ["".join(rng.choices("abcdef ", k=400)) for _ in range(4)]
    rows = [(1, text[0]), (1, text[0]), (2, text[0]), (None, text[1]), (None, text[1]), (3, text[1]), (None, None)]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3)
    found = suffix_dedup.drop_repeats(docs).collect()
    assert sorted(map(str, [(r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in found])) == sorted(map(str, brute(rows)))
    # Of different texts of one id one comes first, whichever.
    rows = [(1, text[2] + text[3]), (1, text[2])]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA)
    assert sum(s.end - s.begin for r in suffix_dedup.drop_repeats(docs).collect() for s in r.removed) == 400
    assert suffix_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_ranges_are_settled_like_one():
    """Sorted items cut anywhere, into batches and ranges, give what they give in one."""
    from types import SimpleNamespace

    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 14)
        items = sorted((rng.randint(0, 2), rng.randint(0, 2), False, rng.randint(0, 4), 0, rng.randint(0, 3)) for _ in range(n))
        first = {}
        for item in sorted(set(items)):
            first.setdefault(item[:2], item)
        kinds = {}
        for core, ctx in first:
            kinds.setdefault(core, set()).add(ctx)
        want = {(suffix_dedup.COPY, i[2:]) for i in set(items) if first[i[:2]] != i}
        want |= {(suffix_dedup.OPEN, i[2:]) for k, i in first.items() if len(kinds[k[0]]) > 1}
        want = sorted((s, *i) for s, i in want for _ in range(1))
        found, edges, at, part = [], [], 0, 0
        while at < n:
            to = rng.randint(at + 1, n)
            while to < n and items[to] == items[to - 1]:  # equal rows are in one range
                to += 1
            edge, own = suffix_dedup.Edge(), items[at:to]
            while own:
                k = rng.randint(1, len(own))
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
                batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in own[:k]], t) for c, t in enumerate(types)], list(suffix_dedup.SORTED))
                copies, opened, before = edge.read(batch)
                found += [(suffix_dedup.COPY, *own[i][2:]) for i in copies] + [(suffix_dedup.OPEN, *own[i][2:]) for i in opened]
                found += [(suffix_dedup.OPEN, *before[2:])] if before else []
                own = own[k:]
            row = lambda state, follows, r: SimpleNamespace(**dict(zip(suffix_dedup.SORTED, r, strict=True)), state=state, follows=follows)
            edges.append(row(suffix_dedup.FIRST, edge.follows, edge.first))
            if edge.follows:
                edges.append(row(suffix_dedup.LAST, 0, edge.waiting or [edge.core, edge.ctx, False, 0, 0, -1]))
            at, part = to, part + 1
        found += suffix_dedup.settled(edges)
        assert sorted(set(found)) == sorted(set(want)), items


def test_query_against_brute_force(spark, tmp_path):
    rows = corpus(8, 80)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_suffix_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(d, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in brute(rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
