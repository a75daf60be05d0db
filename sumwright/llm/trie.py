"""The trie of conversation prefixes by splitters and a skeleton.

A conversation is the path of its turns' digests. Splitters from a sample cut the sorted paths into
shards. The prefixes of splitters are the skeleton: the only nodes that several shards can share, few
enough to be sent to all tasks. A shard is sorted and read once; a node that is left behind is
finished there, unless it is of the skeleton. Of those a shard gives partial sums, which are added
up per node and then along the skeleton, from the leaves to the root.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize

#: Bytes of a turn's digest.
STEP = 16
#: Paths of a shard, roughly, and most shards.
SHARD = 512
MOST_SHARDS = 8192
#: Sampled paths for each splitter, and most bytes of the sample; of long paths it holds the beginning.
PER_SPLITTER = 16
MOST_BYTES = 2**26

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"
NODES, PARTS, ENDS = range(3)


# Paths


def turn_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    said = [F.coalesce(col(name).cast("string"), F.lit("")).alias(to) for name, to in ((role, "role"), (text, "text"))]
    rows = turns.select(col(conv_id).cast("long").alias("conv_id"), col(turn).alias("turn"), *said)
    return rows.where("conv_id is not null")


def paths(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, path, sizes``: the digests of a conversation's turns in order, and their code points.

    Turns go by number, null first, equal numbers by digest, so that repeated rows are repeated
    turns. A null role or text is the empty one. Rows without a conversation belong to none.
    """
    rows = turn_rows(turns, conv_id, turn, role, text)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    one = F.struct("turn", digest.alias("digest"), F.length("text").alias("size"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return listed.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.size").alias("sizes"))


def cut(path: Column, sizes: Column, first: Column | int, last: Column | None = None) -> tuple[Column, Column]:
    """Turns of a path from the ``first`` (1 is the beginning) up to the ``last`` or the end."""
    first = F.lit(first) if isinstance(first, int) else first
    number = F.greatest((F.size(sizes) if last is None else F.least(last, F.size(sizes))) - first + 1, F.lit(0))
    return F.substring(path, (first - 1) * STEP + 1, number * STEP), F.slice(sizes, first, number)


def with_common_heads(found: DataFrame, block: int = 100, kinds: int = 6) -> DataFrame:
    """Paths whose first turns are replaced by those of the first conversation of their block.

    ``h``, the checksum of the id modulo ``kinds``, says how many. Where that conversation has fewer
    turns, all of them are taken; where it does not exist, none.
    """
    most = F.lit(kinds - 1)
    head = cut(F.col("path"), F.col("sizes"), 1, most)
    heads = found.where(F.col("conv_id") % block == 0)
    heads = heads.select(F.col("conv_id").alias("of"), head[0].alias("head"), head[1].alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    both = found.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("of"), "left")
    taken, rest = cut(F.col("head"), F.col("head_sizes"), 1, F.col("h")), cut(F.col("path"), F.col("sizes"), F.col("h") + 1)
    path, sizes = F.concat(taken[0], rest[0]), F.concat(taken[1], rest[1])
    alone = F.col("of").isNull()
    return both.select("conv_id", F.when(alone, rest[0]).otherwise(path).alias("path"), F.when(alone, rest[1]).otherwise(sizes).alias("sizes"))


# The skeleton


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with in common."""
    if a.startswith(b):
        return len(b) // STEP
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * STEP] == b[: middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


class Skeleton:
    """Splitters ``(path, conv_id)`` in order and the nodes on their paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parents = [-1]
        self.depths = [0]
        self.nodes: list[list[int]] = []
        before, last = [0], b""
        for path, _ in splitters:
            before = before[: common(last, path) + 1]
            for depth in range(len(before), len(path) // STEP + 1):
                before.append(len(self.parents))
                self.parents.append(before[depth - 1])
                self.depths.append(depth)
            self.nodes.append(before)
            before, last = list(before), path

    def shard(self, path: bytes, conv: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv))

    def on(self, shard: int, path: bytes) -> list[int]:
        """The skeleton's nodes on a path of this shard, from the root; its neighbours name them all."""
        near = [j for j in (shard - 1, shard) if 0 <= j < len(self.splitters)]
        found = [0]
        for j in near:
            shared = common(path, self.splitters[j][0])
            if shared >= len(found):
                found = self.nodes[j][: shared + 1]
        return found


def skeleton_of(found: DataFrame, shard: int = SHARD) -> Skeleton:
    """Splitters at equal distances in a sample by hash, of bounded size."""
    n = found.count()
    shards = min(max(n // shard, 1), MOST_SHARDS)
    if shards == 1:
        return Skeleton([])
    rows = shards * PER_SPLITTER
    steps = max(MOST_BYTES // (rows * STEP), 1)
    picked = found.orderBy(F.xxhash64("conv_id"), "conv_id").limit(rows)
    begin = F.substring(F.col("path"), F.lit(1), F.lit(steps * STEP))
    sample = sorted((bytes(r.begin), r.conv_id) for r in picked.select(begin.alias("begin"), "conv_id").collect())
    return Skeleton(sample[PER_SPLITTER::PER_SPLITTER])


# Shards


class Node:
    __slots__ = ("size", "on", "n", "conv", "children", "leaves", "saved", "kids", "ends")

    def __init__(self, size: int, on: int):
        self.size, self.on = size, on
        self.n = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.kids: list[tuple] = []
        self.ends: list[int] = []

    def joins(self, n: int, conv: int) -> None:
        self.n += n
        if self.conv is None or conv < self.conv:
            self.conv = conv


class Scan:
    """Reads sorted paths of one shard and gives rows ``(kind, skeleton node, NODE..., size)``.

    It holds the open path and, of the nodes on it that are not of the skeleton, finished children and
    members that end there, which wait for the smallest member.
    """

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        self.open = [Node(0, 0)]
        self.last = b""
        self.rows: list[tuple] = []

    def close(self, depth: int) -> None:
        """Finishes the open nodes deeper than ``depth``."""
        while len(self.open) > depth + 1:
            node = self.open.pop()
            self.finish(node, len(self.open), self.open[-1])

    def finish(self, node: Node, depth: int, parent: Node | None) -> None:
        if parent:
            parent.joins(node.n, node.conv)
        if node.on >= 0:
            own = (None, node.n, node.children, node.leaves, node.saved)
            self.rows.append((PARTS, node.on, node.conv, depth, *own, node.size))
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        self.rows += [(NODES, -1, kid[0], depth + 1, node.conv, *kid[1:], None) for kid in node.kids]
        self.rows += [(ENDS, -1, conv, depth, node.conv, None, None, None, None, None) for conv in node.ends]
        own = (node.conv, node.n, node.children, leaves, saved)
        if parent.on >= 0:
            self.rows.append((NODES, parent.on, node.conv, depth, None, *own[1:], None))
        else:
            parent.kids.append(own)

    def add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        shared = common(path, self.last)
        self.close(shared)
        if len(path) > shared * STEP:
            on = self.skeleton.on(self.shard, path)
            for depth in range(shared + 1, len(path) // STEP + 1):
                self.open.append(Node(sizes[depth - 1], on[depth] if depth < len(on) else -1))
        self.last = path
        end = self.open[-1]
        end.joins(1, conv)
        if end.on >= 0:
            self.rows.append((ENDS, end.on, conv, len(self.open) - 1, None, None, None, None, None, None))
        else:
            end.ends.append(conv)

    def done(self) -> None:
        self.close(0)
        self.finish(self.open.pop(), 0, None)


ROW = f"kind int, node int, {NODE}, size long"
FIELDS = pa.schema(
    [("kind", pa.int32()), ("node", pa.int32())]
    + [(x.split()[0], pa.int64()) for x in NODE.split(", ")]
    + [("size", pa.int64())]
)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)


def trie(found: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of rows ``conv_id, path, sizes`` as :func:`paths` gives them.

    A node stands for each distinct beginning of a path, the root for the empty one: ``conv_id`` and
    ``depth`` (its smallest member and its number of turns, which together name it),
    ``parent_conv_id`` (null at the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes from it on) and ``saved`` (over it and all below, code points of a node's
    last text times its members but one). ``ends`` has for each conversation ``conv_id`` the node
    at which it ends, ``node_conv_id, depth``. Without conversations there is no node.
    """
    spark = found.sparkSession
    found = materialize(found, "paths")
    skeleton = skeleton_of(found, shard)
    held = spark.sparkContext.broadcast(skeleton)

    @F.arrow_udf("int")
    def shard_of(path: pa.Array, conv: pa.Array) -> pa.Array:
        keys = zip(path.to_pylist(), conv.to_pylist(), strict=True)
        return pa.array([held.value.shard(*key) for key in keys], pa.int32())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for at, path, conv, sizes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now.shard != at:
                    if now is not None:
                        now.done()
                        yield batch_of(now.rows)
                    now = Scan(held.value, at)
                now.add(path, conv, sizes)
                if len(now.rows) >= 50_000:
                    yield batch_of(now.rows)
                    now.rows = []
        if now is not None:
            now.done()
            yield batch_of(now.rows)

    dealt = found.select(shard_of("path", "conv_id").alias("shard"), "path", "conv_id", "sizes")
    dealt = dealt.repartition(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    rows = materialize(dealt.mapInArrow(scan, ROW), "trie")
    top = spark.createDataFrame(reduced(rows, skeleton), f"node int, {NODE}")
    # At most as many rows as the sample has turns.
    names = F.broadcast(top.select(F.col("node").alias("of"), F.col("conv_id").alias("top")))
    named = rows.where(F.col("kind") != PARTS).join(names, F.col("node") == F.col("of"), "left")
    named = named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top"))
    fields = [x.split()[0] for x in NODE.split(", ")]
    nodes = named.where(F.col("kind") == NODES).select(*fields).union(top.select(*fields))
    ends = named.where(F.col("kind") == ENDS)
    return nodes, ends.select("conv_id", F.col("parent_conv_id").alias("node_conv_id"), "depth")


def reduced(rows: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """The skeleton's nodes: partial sums of the shards, then those of children into parents."""
    parts = rows.where(F.col("kind") == PARTS).groupBy("node").agg(
        F.min("conv_id").alias("conv"),
        F.max("size").alias("size"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    sums = {r.node: [r.conv, r.n_convs, r.n_children, r.n_leaves, r.saved, r.size] for r in parts.collect()}
    for node in sorted(sums, reverse=True):  # children have higher numbers than their parents
        own = sums[node]
        own[3] = own[3] or 1
        own[4] += (own[1] - 1) * own[5]
        if skeleton.parents[node] >= 0:
            parent = sums[skeleton.parents[node]]
            parent[2] += 1
            parent[3] += own[3]
            parent[4] += own[4]
    found = []
    for node, (conv, *numbers, _) in sums.items():
        above = skeleton.parents[node]
        found.append((node, conv, skeleton.depths[node], sums[above][0] if above >= 0 else None, *numbers))
    return found


def ends_sha256(ends: DataFrame, block: int = 8192) -> DataFrame:
    """``node_conv_id, depth, ends_sha256``: the SHA-256 of the ids that end at a node, ascending,
    joined by commas.

    Sorted ranges of ids become blocks of text first, so that a node at which very many end is
    joined by many tasks; only the hash itself takes its blocks one after the other.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, rows = None, [], []

        def put() -> None:
            if ids:
                rows.append((*node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["node_conv_id", "depth", "first", "ids"])

        for one in batches:
            for *of, conv in zip(*(one.column(i).to_pylist() for i in range(3)), strict=True):
                if of != node or len(ids) == block:
                    put()
                    node = of
                ids.append(conv)
            yield batch()
        put()
        yield batch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, rows = None, None, []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["node_conv_id", "depth", "ends_sha256"])

        for one in batches:
            for *of, ids in zip(*(one.column(i).to_pylist() for i in range(3)), strict=True):
                if of == node:
                    digest.update(b",")
                else:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = of, hashlib.sha256()
                digest.update(ids.encode())
            yield batch()
        if node:
            rows.append((*node, digest.hexdigest()))
        yield batch()

    key = ["node_conv_id", "depth", "conv_id"]
    blocks = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    blocks = blocks.mapInArrow(joined, "node_conv_id long, depth long, first long, ids string")
    blocks = blocks.repartition("node_conv_id", "depth").sortWithinPartitions("node_conv_id", "depth", "first")
    return blocks.select("node_conv_id", "depth", "ids").mapInArrow(hashed, "node_conv_id long, depth long, ends_sha256 string")


def with_turns(
    nodes: DataFrame, turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Nodes with the ``role`` and ``text`` of their last turn, of which the root has none."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), digest)
    numbered = turn_rows(turns, conv_id, turn, role, text).withColumn("depth", F.row_number().over(order).cast("long"))
    return nodes.join(numbered.drop("turn"), ["conv_id", "depth"], "left")
