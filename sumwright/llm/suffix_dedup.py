"""Dedup of repeated byte strings by refining buckets of suffixes.

Every string of ``length`` bytes is asked whether it also starts earlier. As in bucket-pointer
refinement, suffixes begin in buckets of their first q-gram, buckets are refined by sorting on the
identifiers of what stands at later offsets, and only buckets that are still mixed go on.

- Not all suffixes are sorted but *anchors*: the q-gram with the least identifier in each window of
  ``length`` bytes. Equal windows have equal anchors at equal offsets, so no repeat is lost. One
  anchor stands for the consecutive windows that it is the least in.
- The identifier of a longer string is made of those of shorter ones at later offsets, doubling by
  doubling, and is a 64-bit number, so that a task finds it in its own text instead of in a table.
- Sorted by q-gram, then by all that the anchor's windows cover, a member is a copy of the one before
  it, and gone whole; the first of its kind is new if its bucket has no other kind. Else its
  windows are open: they are cut into smaller cells, which are buckets themselves, down to single
  windows. Two identifiers of 64 bits decide that strings are equal.

Buckets are cut by range in the full order, so one of any size spreads over many tasks; what reaches
over the border of two ranges is settled from the first and last rows of the ranges.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize, mixed, packed, row_blocks, unpacked

LENGTH = 100
#: Windows of an anchor that a cell of the second round holds.
CELL = 9
#: Most bytes that are searched for anchors at once; places inside have 16 bits.
BLOCK = 48 * 1024

COPY, OPEN, FIRST, LAST = range(4)
KEY = ("none", "id", "tie")
ITEM = "core long, ctx long, none boolean, id long, tie int, place long"
SORTED = ("core", "ctx", *KEY, "place")


def gram_of(length: int) -> int:
    if not 24 <= length <= 256:
        raise ValueError("strings of 24 to 256 bytes can be searched")
    return 1 << ((length // 3).bit_length() - 1)


# Places: an anchor and the least and greatest distance from the start of its windows to it.


def place_of(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return at << 16 | low << 8 | high


def range_of(place: int) -> tuple[int, int, int]:
    return place >> 16, place >> 8 & 255, place & 255


def key_of(doc_id: Column, text: Column) -> dict[str, Column]:
    """What documents are told apart and ordered by: null ids last, then the id, then the text."""
    return {
        "none": doc_id.isNull(),
        "id": F.coalesce(doc_id.cast("long"), F.xxhash64(text)),
        "tie": F.hash(text),
    }


# Anchors


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Identifiers of the ``size`` bytes (a power of two from 8 on) from each place on."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), 0, (1,))
    ids, own = mixed(eight, np.uint64(8)), 8
    while own < size:
        ids = mixed(ids[:-own], ids[own:])
        own *= 2
    return ids


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, own = values, 1
    while 2 * own <= width:
        least = np.minimum(least[:-own], least[own:])
        own *= 2
    rest = width - own
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: np.ndarray, text_of: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``at, first, last, core, ctx`` of the anchors of a block of whole texts or of one long one.

    ``first`` and ``last`` are the starts of the windows that an anchor stands for; ``ctx`` names all
    that they cover and where in it the anchor is.
    """
    size = gram_of(length)
    ids = grams(data, size)
    marked = (ids & ~np.uint64(0xFFFF)) | np.arange(len(ids), dtype=np.uint64)
    at = (sliding_least(marked, length - size + 1) & np.uint64(0xFFFF)).astype(np.int64)
    whole = text_of[: len(at)] == text_of[length - 1 :]
    at[~whole] = -1  # no window reaches into the next text
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    real = at[first] >= 0
    first, last = first[real], last[real]
    at = at[first]

    def window(start: np.ndarray) -> np.ndarray:
        found = ids[start]
        for offset in (*range(size, length - size, size), length - size):
            found = mixed(found, ids[start + offset])
        return found

    shape = (last - first) << 16 | (at - first)
    ctx = mixed(mixed(window(first), window(last)), shape.astype(np.uint64))
    return at, first, last, ids[at], ctx


def blocks_of(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``data, text_of, offset``: bytes, the row of each, and where they begin if they are part of one."""
    for row, number in row_blocks(texts, BLOCK // 2):
        parts = [np.frombuffer(t.as_buffer() if t.is_valid else b"", np.uint8) for t in texts[row : row + number]]
        data = np.concatenate(parts)
        text_of = np.repeat(np.arange(row, row + number), [len(p) for p in parts])
        if len(data) <= BLOCK:
            if len(data) >= length:
                yield data, text_of, 0
            continue
        for part, one in enumerate(parts):
            for offset in range(0, max(len(one) - length + 1, 0), BLOCK - length):
                piece = one[offset : offset + BLOCK - 1]
                yield piece, np.full(len(piece), row + part), offset


def items_of(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``row, place, core, ctx, again`` of the anchors in a batch, by block.

    ``again`` marks those that repeat an earlier one of their text inside the block.
    """
    for data, text_of, offset in blocks_of(texts, length):
        at, first, last, core, ctx = anchors(data, text_of, length)
        row = text_of[at]
        begins = np.flatnonzero(np.concatenate([[True], text_of[1:] != text_of[:-1]]))
        start = begins[np.searchsorted(begins, at, "right") - 1] - offset
        order = np.lexsort((at, ctx, core, row))
        same = [x[order][1:] == x[order][:-1] for x in (row, core, ctx)]
        again = np.zeros(len(at), bool)
        again[order[1:]] = same[0] & same[1] & same[2]
        yield row, place_of(at - start, at - last, at - first), core, ctx, again


def anchor_items(docs: DataFrame, length: int) -> DataFrame:
    """Items of rows :data:`KEY`, ``data``: anchors by what they and their windows are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i) for i in range(3)]
            for row, place, core, ctx, again in items_of(batch.column(3), length):
                new = ~again
                take = pa.array(row[new])
                columns = [pa.array(core[new].view(np.int64)), pa.array(ctx[new].view(np.int64))]
                columns += [k.take(take) for k in keys] + [pa.array(place[new])]
                yield pa.RecordBatch.from_arrays(columns, list(SORTED))

    return docs.select(*KEY, "data").mapInArrow(make, ITEM)


# Refinement


class Edge:
    """What is known of a range while its sorted rows are read."""

    def __init__(self):
        self.first: list | None = None  # the first row, and 0, 1, 2: no class follows its class, one of its bucket, another
        self.follows = 0
        self.core = self.ctx = None
        self.last: list | None = None  # the last row read
        self.waiting: list | None = None  # the first of the last class, if alone in its bucket so far

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list | None]:
        """Places of copies and of open rows in the batch, and an open row from before."""
        core, ctx = (batch.column(i).to_numpy() for i in (0, 1))
        rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]

        def before(values: np.ndarray, own) -> np.ndarray:
            return np.concatenate([[values[0] if own is None else own], values[:-1]]).astype(values.dtype)

        begins = self.first is None
        near, kind = core == before(core, self.core), ctx == before(ctx, self.ctx)
        old = [x == before(x, self.last[i + 2] if self.last else None) for i, x in enumerate(rest)]
        same = np.logical_and.reduce([near, kind, *old])  # one document twice: rows that agree in id and text
        new = ~(near & kind)
        if begins:
            new[0], same[0] = True, False
        heads = np.flatnonzero(new)
        opened = None
        if len(heads):
            after = core[heads[1:]] == core[heads[:-1]]
            if begins:
                self.first = self.row(batch, 0)
                if len(after):
                    self.follows = 1 if after[0] else 2
            else:
                if not self.follows:
                    self.follows = 1 if near[heads[0]] else 2
                if self.waiting and near[heads[0]]:
                    opened = self.waiting
            mixed_up = near[heads]
            if begins:
                mixed_up[0] = False
            mixed_up[:-1] |= after
            self.waiting = None
            if not mixed_up[-1] and not (begins and len(heads) == 1):
                self.waiting = self.row(batch, int(heads[-1]))
            if begins:
                mixed_up[0] = False
            found = heads[mixed_up]
        else:
            found = heads
        self.core, self.ctx = core[-1], ctx[-1]
        self.last = self.row(batch, len(core) - 1)
        return np.flatnonzero(~new & ~same), found, opened

    @staticmethod
    def row(batch: pa.RecordBatch, i: int) -> list:
        return [batch.column(c)[i].as_py() for c in range(6)]


OUT = f"part int, state int, follows int, {ITEM}"
OUT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def refined(items: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """:data:`KEY`, ``place`` of copies, and of the open ones, of items.

    A copy has an earlier item of the same core and context, an open item has none, but others of the
    same core. What remains is new for certain.
    """

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, part = Edge(), TaskContext.get().partitionId()

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(OUT_TYPES)]
            return pa.RecordBatch.from_arrays(columns, OUT_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            copies, found, opened = edge.read(batch)
            if opened:
                yield rows_of([(part, OPEN, 0, *opened)])
            for state, at in ((COPY, copies), (OPEN, found)):
                own = batch.take(pa.array(at))
                numbers = [np.full(len(at), n, np.int32) for n in (part, state, 0)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), *own.columns], OUT_NAMES)
        if edge.first:
            rows = [(part, FIRST, edge.follows, *edge.first)]
            if edge.follows:
                waits = edge.waiting or [int(edge.core), int(edge.ctx), False, 0, 0, -1]
                rows.append((part, LAST, 0, *waits))
            yield rows_of(rows)

    dealt = items.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED)
    rows = materialize(dealt.mapInArrow(sort_out, OUT), label)
    release(items.sparkSession)
    # Two rows for each range.
    borders = settled(rows.where(F.col("state") >= FIRST).orderBy("part", "state").collect())
    borders = items.sparkSession.createDataFrame(borders, "state int, none boolean, id long, tie int, place long")
    rows = rows.select("state", *KEY, "place").union(borders)
    return tuple(rows.where(F.col("state") == state).select(*KEY, "place") for state in (COPY, OPEN))


def settled(edges: list) -> list[tuple]:
    """``state, key, place`` of the rows at the borders of ranges, in the order of the ranges."""
    found: list[tuple] = []
    core = ctx = None
    waiting = None

    def opens(row) -> None:
        if row is not None:
            found.append((OPEN, row.none, row.id, row.tie, row.place))

    for row in edges:
        if row.state == LAST:
            core, ctx, waiting = row.core, row.ctx, row if row.place >= 0 else None
            continue
        if (row.core, row.ctx) == (core, ctx):
            found.append((COPY, row.none, row.id, row.tie, row.place))
            if row.follows == 1:
                opens(waiting)
        else:
            near = row.core == core
            if near:
                opens(waiting)
            if near or row.follows == 1:
                opens(row)
            core, ctx = row.core, row.ctx
            waiting = row if not near and row.follows == 0 else None
        if row.follows:
            waiting = None
    return found


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the garbage collector finds that nobody needs them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Rounds


def listed(places: DataFrame) -> DataFrame:
    """Places by document. A document has at most as many as it has bytes."""
    lists = places.groupBy(*KEY).agg(F.collect_list("place").alias("places"))
    return lists.select(*[F.col(k).alias(f"of_{k}") for k in KEY], "places")


def of_document() -> Column:
    same = [F.col(k) == F.col(f"of_{k}") for k in KEY]
    return same[0] & same[1] & same[2]


def contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """:data:`KEY`, ``place, data`` with the bytes that the windows of a place cover."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, parts = [], [], []
            for i, (data, places) in enumerate(zip(batch.column(3), batch.column(4).to_pylist(), strict=True)):
                text = memoryview(data.as_buffer())
                for place in places:
                    anchor, low, high = range_of(place)
                    rows.append(i)
                    at.append(place)
                    parts.append(bytes(text[anchor - high : anchor - low + length]))
            take = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(take) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int64()), pa.array(parts, pa.binary())], [*KEY, "place", "data"])

    both = docs.join(listed(places), of_document()).select(*KEY, "data", "places")
    return both.mapInArrow(cut, "none boolean, id long, tie int, place long, data binary")


def cells(parts: DataFrame, length: int, size: int) -> DataFrame:
    """Items of the windows in :func:`contexts`, those at ``size`` neighbouring distances in one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh64_intdigest
        for batch in batches:
            rows, made = [], []
            for i, (place, data) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                at, low, high = range_of(place)
                for cell in range(low // size, high // size + 1):
                    near, far = cell * size, cell * size + size - 1
                    a, b = max(low, near), min(high, far)
                    core = of(data[high - near : high - far + length], cell)
                    ctx = of(data[high - b : high - a + length], 1 + ((a - near) << 8 | b - near))
                    rows.append(i)
                    made.append((core, ctx, at << 16 | a << 8 | b))
            numbers = np.array(made, np.uint64).reshape(-1, 3).T.copy().view(np.int64)
            take = pa.array(rows, pa.int64())
            keys = [batch.column(c).take(take) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[0]), pa.array(numbers[1]), *keys, pa.array(numbers[2])], list(SORTED))

    return parts.mapInArrow(make, ITEM)


def copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """:data:`KEY`, ``place`` of all windows that also start earlier, but for those that repeat
    inside a block of their text, of rows :data:`KEY`, ``data``."""
    found, opened = refined(anchor_items(docs, length), "anchors")
    for size in (CELL, 1):
        parts = materialize(contexts(docs, opened, length), "contexts")
        release(docs.sparkSession)
        more, opened = refined(cells(parts, length, size), "cells")
        found = found.union(more)
    return found


def drop_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``n_bytes``, ``removed`` and ``kept``; columns of these names are replaced.

    Texts are UTF-8 bytes. A byte is removed if it is in a string of ``length`` bytes that also starts
    earlier: in a document that comes before, or earlier in its own. ``removed`` has the spans
    ``begin, end`` of them, none of which touch, ``kept`` the bytes that are left. Strings never cross
    documents and are judged on the whole input. Ids are whole numbers. Documents come by id, null
    ids last; those that share an id or have none by a hash of their text. Rows that agree in id and
    text are one document and get the same result. Null texts are empty; an empty table has no rows.
    """
    data = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    rows = packed(docs, **key_of(col(doc_id), col(text).cast("string")), data=data)
    places = listed(copies(rows.select(*KEY, "data"), length))
    both = rows.join(materialize(places, "places"), of_document(), "left")

    @F.arrow_udf("struct<removed:array<struct<begin:long,end:long>>,kept:binary>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        again: dict[int, list[np.ndarray]] = {}
        for row, place, _, _, repeats in items_of(texts, length):
            mine, own = row[repeats], place[repeats]
            border = np.flatnonzero(np.diff(mine)) + 1
            for r, p in zip(mine[np.concatenate([[0], border])] if len(mine) else [], np.split(own, border), strict=False):
                again.setdefault(int(r), []).append(p)
        removed, kept = [], []
        for i, (data, listed) in enumerate(zip(texts, places, strict=True)):
            found = again.get(i, [])
            if listed.is_valid:
                found = [*found, listed.values.to_numpy()]
            spans = spans_of(np.concatenate(found), length) if found else []
            removed.append([{"begin": a, "end": b} for a, b in spans])
            whole = memoryview(data.as_buffer())
            borders = [0, *[x for span in spans for x in span], len(whole)]
            kept.append(b"".join(whole[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)))
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        return pa.StructArray.from_arrays([pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], ["removed", "kept"])

    both = both.withColumn("cut", cut("data", "places"))
    columns = {name: F.col("cut").getField(name) for name in ("removed", "kept")}
    return unpacked(both, docs, n_bytes=F.octet_length("data").cast("long"), **columns)


def spans_of(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that the windows of places cover, as spans that do not touch."""
    at, low, high = places >> 16, places >> 8 & 255, places & 255
    begin, end = at - high, at - low + length
    order = np.argsort(begin)
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    apart = np.concatenate([[True], begin[1:] > reach[:-1]])
    first = np.flatnonzero(apart)
    last = np.concatenate([first[1:], [len(begin)]]) - 1
    return list(zip(begin[first].tolist(), reach[last].tolist(), strict=True))
