"""SimHash near-duplicates by a vantage-point tree over fingerprints.

Texts become 64-bit fingerprints of their word shingles. Distinct fingerprints are dealt out to
the leaves of a vantage-point tree by Hamming distance; a fingerprint near a border also visits the
leaves on the other side, which the triangle inequality names. Leaves are compared exactly, and the
links found there are joined into components. The tree only decides who meets whom: links do not
depend on the sample it is built from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm.line_dedup import line_key
from sumwright.llm.shared import col, materialize, packed, unpacked

WORDS = 3
RADIUS = 2
LEAF = 1024
#: Most fingerprints that build the tree, 8 bytes each, and most leaves.
SAMPLE = 2**19
LEAVES = 2**16
#: Rows of one leaf compared in one group; larger leaves are compared cell by cell.
CELL = 2**15

LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ``text``, in blocks."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    if len(parts) < words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
        return
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = len(parts) - words + 1
    for at in range(0, last, 65536):
        to = min(at + 65536, last)
        begin, end = starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist()
        hashes = (digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True))
        yield np.fromiter(hashes, np.uint64, to - at)


def simhash(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number; 0 without words.

    A bit is set if it is set in over half the hashes. The eight bits of the same place in each
    byte are summed side by side, up to 255 hashes at a time.
    """
    counts, n = np.zeros((8, 8), np.int64), 0
    for hashes in shingle_hashes(text or "", words):
        n += len(hashes)
        cuts = np.arange(0, len(hashes), 255)
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
            counts[:, bit] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).reshape(64)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """:func:`simhash` as a long of the same bits. Null and blank texts give 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# The tree


class Tree:
    """Nodes in arrays: ``far`` is the radius of the near side; children below 0 are leaves."""

    def __init__(self, vantage: np.ndarray, far: np.ndarray, children: np.ndarray, leaves: int):
        self.vantage, self.far, self.children, self.leaves = vantage, far, children, leaves

    @classmethod
    def build(cls, sample: np.ndarray, leaves: int, radius: int) -> Tree:
        """Splits the sample until a part holds its share for one of ``leaves`` leaves.

        Of some vantage points and borders between the quartiles, the one is taken that leaves the
        fewest points of the sample near the border.
        """
        least = max(len(sample) / max(leaves, 1), 2)
        vantage, far, children, n_leaves = [], [], [], 0
        pending = [(np.sort(sample), None)]
        while pending:
            points, parent = pending.pop()
            best = None
            if len(points) > least:
                for v in points[:: max(len(points) // 12, 1)][:12]:
                    d = np.bitwise_count(points ^ v).astype(np.int64)
                    at_most = np.cumsum(np.bincount(d, minlength=65))
                    for mu in range(65):
                        near = at_most[mu]
                        if not len(points) / 4 <= near <= 3 * len(points) / 4:
                            continue
                        border = at_most[min(mu + radius, 64)] - (at_most[mu - radius] if mu >= radius else 0)
                        cost = (border + abs(len(points) / 2 - near) / 4, mu)
                        if best is None or cost < best[0]:
                            best = (cost, v, mu, d)
            if best is None:
                n_leaves += 1
                me = -n_leaves
            else:
                me = len(vantage)
                vantage.append(best[1])
                far.append(best[2])
                children.append([0, 0])
                near = best[3] <= best[2]
                pending += [(points[~near], (me, 1)), (points[near], (me, 0))]
            if parent:
                children[parent[0]][parent[1]] = me
        return cls(
            np.array(vantage, np.uint64),
            np.array(far, np.int64),
            np.array(children, np.int64).reshape(-1, 2),
            n_leaves,
        )

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(leaf, indexes, home)``: each point once at home, and as visitor where its ball reaches.

        A point at home on the near side visits the far side; those of the far side need not visit
        back, since each pair has to meet once only.
        """
        everything = np.arange(len(points))
        pending = [(0 if len(self.vantage) else -1, everything, np.ones(len(points), bool))]
        while pending:
            node, rows, home = pending.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows, home
                continue
            d = np.bitwise_count(points[rows] ^ self.vantage[node]).astype(np.int64)
            mu = self.far[node]
            near = np.where(home, d <= mu, d <= mu + radius)
            beyond = d > mu - radius
            pending.append((self.children[node, 0], rows[near], home[near]))
            pending.append((self.children[node, 1], rows[beyond], home[beyond] & (d[beyond] > mu)))


def leaf_links(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each point the index of the first of its component in this leaf.

    Points at home are compared with all others, block by block.
    """
    first = np.arange(len(points))
    at_home = np.flatnonzero(home)
    for start in range(0, len(points), 512):
        block = points[start : start + 512]
        for begin in range(0, len(at_home), 8192):
            part = at_home[begin : begin + 8192]
            a, b = np.nonzero(np.bitwise_count(block[:, None] ^ points[part][None, :]) <= radius)
            a, b = a + start, part[b]
            a, b = a[a != b], b[a != b]
            while len(a):
                low = np.minimum(first[a], first[b])
                np.minimum.at(first, first[a], low)
                np.minimum.at(first, first[b], low)
                while not np.array_equal(first, first[first]):
                    first = first[first]
                apart = first[a] != first[b]
                a, b = a[apart], b[apart]
    return first


def links(fingerprints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """``a, b`` of distinct fingerprints ``fp``: enough links to connect every component.

    Where a leaf finds a group linked, its members are tied to one of them instead of to each
    other, so a dense group gives as many rows as it has members.
    """
    spark = fingerprints.sparkSession
    n = fingerprints.count()
    leaves = min(max(n // leaf, 1), LEAVES)
    sample = fingerprints.orderBy(F.xxhash64("fp"), "fp").limit(min(leaves * 32, SAMPLE))
    picked = np.array([r.fp for r in sample.collect()] if leaves > 1 else [], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(Tree.build(picked, leaves, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at, rows, home in tree.value.route(points, radius):
                columns = [np.full(len(rows), at, np.int32), points[rows].view(np.int64), home]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "fp", "home"])

    dealt = materialize(fingerprints.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean"), "vp-leaves")
    # One row for each leaf, of which there are LEAVES at most.
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    cut = dealt.join(F.broadcast(sizes), "leaf")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = cut.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "home")

    def compare(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        first = leaf_links(points, group.column("home").to_numpy(zero_copy_only=False).astype(bool), radius)
        tied = np.flatnonzero(points != points[first])
        ends = [points[tied].view(np.int64), points[first[tied]].view(np.int64)]
        return pa.table(ends, names=["a", "b"])

    return cells.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long")


# Components


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of edges ``a, b``: the smallest node that each can reach.

    Every round ties the larger neighbours of a node to its smallest neighbour, then all of its
    smaller ones, until nothing changes; only sums reach the driver. Joins and aggregates go by
    node, and adaptive execution splits a node with very many neighbours.
    """
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = materialize(edges.where("a != b").select(*up).distinct(), "links")
    seen = None
    while True:
        sign = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign.n == 0 or (sign.n, sign.s) == seen:
            break
        seen = (sign.n, sign.s)
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), "links")
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m")))
        small = small.select(pairs.alias("p")).select("p.u", F.col("p.m").alias("v"))
        stars = materialize(small.where("u != v").distinct(), "links")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select("v", "v").distinct()
    )


def components(rows: DataFrame, find: Callable[[DataFrame], DataFrame], *names: Column) -> DataFrame:
    """Fingerprint ``of`` with aggregates over its whole component.

    ``find`` gives the links ``a, b`` of the distinct fingerprints ``fp``.
    They are the minima of ``names`` as columns ``c0``, ``c1`` and so on, taken first per
    fingerprint and then per component.
    """
    made = [f"c{i}" for i in range(len(names))]
    groups = rows.groupBy("fp").agg(*[F.min(x).alias(c) for c, x in zip(made, names, strict=True)])
    groups = materialize(groups, "distinct")
    member = materialize(connected(find(groups.select("fp"))), "members")
    linked = groups.join(member, F.col("fp") == F.col("node"))
    tops = linked.groupBy(F.col("root").alias("top")).agg(*[F.min(c).alias(f"t_{c}") for c in made])
    named = linked.select("node", "root").join(tops, F.col("root") == F.col("top"))
    both = groups.join(named, F.col("fp") == F.col("node"), "left")
    whole = [F.when(F.col("node").isNull(), F.col(c)).otherwise(F.col(f"t_{c}")).alias(c) for c in made]
    return both.select(F.col("fp").alias("of"), *whole)


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    radius: int = RADIUS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    The component is named by its smallest id; rows with a null id take part and name none, a
    component of such rows alone has a null name. Repeated rows give repeated rows. Null and blank
    texts have fingerprint 0 and link like any other. An empty table gives no rows.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), fingerprint(col(text), words).alias("fp"))
    rows = materialize(rows, "fingerprints")
    # Written, so that both sides of the join are plain and a fingerprint of many rows is split.
    ids = materialize(components(rows, lambda fps: links(fps, radius), F.col("doc_id")).withColumnRenamed("c0", "component_id"), "ids")
    found = rows.join(ids, F.col("fp") == F.col("of"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame,
    words: int = WORDS,
    radius: int = RADIUS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with the columns of ``docs``.

    The smallest id stays, a null one only if there is no other; among rows of that id the text
    with the smallest hash, and one of rows that agree in both.
    """
    name = name_of(doc_id, text)
    rows = docs.select(name.alias("name"), fingerprint(col(text), words).alias("fp"))
    rows = materialize(rows, "fingerprints")
    first = components(rows, lambda fps: links(fps, radius), F.col("name")).select(F.col("c0").alias("name"))
    return one_of_each(docs, name, first)


def name_of(doc_id: str, text: str) -> Column:
    """What rows are chosen by: null ids last, then the id and the hash of the text."""
    return F.struct(
        col(doc_id).isNull().alias("none"),
        col(doc_id).alias("id"),
        F.coalesce(line_key(col(text)), F.lit("")).alias("key"),
    )


def one_of_each(docs: DataFrame, name: Column, first: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``name`` in ``first``; of rows that agree in it, the one whose
    columns' hashes come first, whatever their types are."""
    # One aggregate instead of a join and an aggregate: texts move once, and rows that repeat id and
    # text are one before they do.
    order = F.struct(*[F.xxhash64(col(c).cast("string")).alias(f"o{i}") for i, c in enumerate(docs.columns)])
    both = packed(docs, name=name, order=order).withColumn("stays", F.lit(False))
    both = both.unionByName(first.withColumn("stays", F.lit(True)), allowMissingColumns=True)
    single = both.groupBy("name").agg(F.min_by("row", "order").alias("row"), F.max("stays").alias("stays"))
    return unpacked(single.where("stays"), docs)
