import hashlib
import random
import zlib

import duckdb
import pytest

from sumwright.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth string"


def brute(sequences):
    """``{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)}`` of ``{conv: [(role, text)]}``."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(conv)
    found = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        ends = sorted(c for c in own if len(sequences[c]) == len(node))
        found[min(own), len(node)] = (parent, len(own), len(children), len(leaves), saved, ends)
    return found


def sequences(rows):
    """The conversations of rows, in the operator's order."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}


def conversations(seed=5, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(450), n):
        kind = rng.random()
        for turn in range(4 if kind < 0.3 else rng.randint(0, 7)):
            text = f"same {turn}" if kind < 0.3 else rng.choice(["yes", "no", "é 😀", "", None, "x" * 40])
            rows.append((conv, rng.choice([turn, turn, None]), ["user", "bot", None][turn % 3], text))
    rows += [(100, 0, "user", "yes"), (100, 0, "user", "yes"), (7, None, "u", "long " * 20_000), (None, 1, "user", "lost")]
    rows += [(400, t, "user", f"turn {t}") for t in range(300)]
    rng.shuffle(rows)
    return rows


def found_by(spark, rows, shard):
    turns = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(3)
    nodes, ends = trie.trie(trie.paths(turns), shard)
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in nodes.collect()}
    assert nodes.columns == [x.split()[0] for x in trie.NODE.split(", ")]
    at = {}
    for r in ends.collect():
        at.setdefault((r.node_conv_id, r.depth), []).append(r.conv_id)
    assert set(at) <= set(got)
    return {k: (*v, sorted(at.get(k, []))) for k, v in got.items()}, nodes, ends, turns


@pytest.mark.parametrize("shard", [1, 7, 40, 10_000])
def test_nodes_and_ends_whatever_the_shards(spark, shard):
    rows = conversations()
    want = brute(sequences(rows))
    got, nodes, ends, turns = found_by(spark, rows, shard)
    assert got == want
    hashes = {(r.node_conv_id, r.depth): r.ends_sha256 for r in trie.ends_sha256(ends, 3).collect()}
    text = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert hashes == {k: text(v[-1]) for k, v in want.items() if v[-1]}
    if shard == 40:
        own = sequences(rows)
        for r in trie.with_turns(nodes, turns).collect():
            assert (r.role, r.text) == (own[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_long_paths_are_cut_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(trie, "MOST_BYTES", 1)
    rows = conversations(6)
    assert found_by(spark, rows, 3)[0] == brute(sequences(rows))


def test_equal_conversations_are_split(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(3)] + [(c, 0, "user", "t0") for c in range(60, 90)]
    assert found_by(spark, rows, 4)[0] == brute(sequences(rows))
    nodes, ends = trie.trie(trie.paths(spark.createDataFrame([], SCHEMA)))
    assert nodes.count() == ends.count() == 0


def rebuilt(own):
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return made


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = [r for r in conversations(9, 200) if r[0] != 200]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    query = queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path))
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in query.collect()}
    text = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    want = {k: (*v[:-1], text(v[-1])) for k, v in brute(rebuilt(sequences(rows))).items()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    table = con.execute(queries.ORACLES["op12_conversation_trie"]).to_arrow_table().to_pylist()
    assert sorted(str(tuple(r[c] for c in query.columns)) for r in table) == sorted(str((*k, *v)) for k, v in want.items())
