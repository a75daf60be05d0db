"""Documents in parts, of any length: one document is cut into chunks by many tasks.

Where a chunk ends and the next one starts depends on the characters near by alone: every border
of a document has a successor. Blocks of a document are summed up as functions from the place where
a first chunk starts to the same place in the next block (pointer doubling inside a block), these
are composed in groups, and then every block is cut from its own place on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwright.operators.corpus import CHUNK_OVERLAP, CHUNK_SIZE
from sumwright.session import checkpointed

#: Characters of a block, and functions that one task composes at a time.
BLOCK = 2**18
GROUP = 256
#: Blocks or groups of a row group; a task reads these at once.
ROWS = 16

_FAR = 2**60
_BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def with_offsets(parts: DataFrame, doc: str, part: str, text: str) -> DataFrame:
    """``doc, start, text``: every part with the number of characters before it in its document.

    Parts are dealt out by ranges of document and part, and lengths are added up as a range goes by.
    Only the first document of a range can have begun in earlier ones; what it brings along is
    summed over one row for each range.
    """
    doc_type = parts.schema[doc].dataType.simpleString()
    rows = parts.select(_col(doc).alias("doc"), _col(part).alias("part"), _col(text).alias("text")).where("text != ''")
    rows = rows.withColumns({"tie": F.md5("text"), "length": F.length("text"), "key": F.col("doc").cast("string")})
    order = ("doc", "part", "tie")
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranges.select(F.spark_partition_id().alias("range"), "doc", "key", "text", F.col("length").cast("long"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, at, last, first = 0, 0, None, True
        for batch in batches:
            places, heads, numbers = [], [], []
            for key, length in zip(batch.column("key").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if nth and key != last:
                    at, first = 0, False
                places.append(at)
                heads.append(first)
                numbers.append(nth)
                nth, at, last = nth + 1, at + length, key
            made = {"at": pa.array(places, pa.int64()), "head": pa.array(heads, pa.bool_()), "nth": pa.array(numbers, pa.int64())}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | made)

    schema = f"range int, doc {doc_type}, key string, text string, length long, at long, head boolean, nth long"
    ranges = checkpointed(ranges.mapInArrow(add_up, schema), "ranges")
    ends = ranges.groupBy("range").agg(
        F.min_by("key", "nth").alias("first"),
        F.max_by("key", "nth").alias("last"),
        F.max_by(F.col("at") + F.col("length"), "nth").alias("tail"),
    )
    # A range asks what its first document has so far, and then adds what its last one brings along.
    asks = ends.select(F.col("first").alias("key"), "range", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tail"))
    brings = ends.select(F.col("last").alias("key"), "range", F.lit(1).alias("kind"), "tail")
    before = Window.partitionBy("key").orderBy("range", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.unionByName(brings).withColumn("carried", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    carried = carried.where("kind = 0").select("range", "carried")
    start = F.col("at") + F.when(F.col("head"), F.col("carried")).otherwise(0)
    return ranges.join(F.broadcast(carried), "range").select("doc", start.alias("start"), "text")


def blocks(placed: DataFrame, block: int, left: int, right: int) -> DataFrame:
    """``doc, block, text``: blocks of a document, each with ``left`` characters before and ``right``
    after it, as far as the document goes."""
    doc_type = placed.schema["doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, places, pieces = [], [], [], []
            starts = batch.column("start").to_pylist()
            for row, (start, text) in enumerate(zip(starts, batch.column("text").to_pylist(), strict=True)):
                end = start + len(text)
                for b in range(max((start - right) // block, 0), (end - 1 + left) // block + 1):
                    begin, stop = max(b * block - left, start), min((b + 1) * block + right, end)
                    if begin < stop:
                        rows.append(row)
                        numbers.append(b)
                        places.append(begin)
                        pieces.append(text[begin - start : stop - start])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(pieces, pa.string()),
                ],
                ["doc", "block", "at", "piece"],
            )

    pieces = placed.mapInArrow(cut, f"doc {doc_type}, block long, at long, piece string")
    whole = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined = F.array_join(F.transform(whole, lambda p: p["piece"]), "")
    made = pieces.groupBy("doc", "block").agg(joined.alias("text"))
    # What lies behind the end of a document has nothing but the characters before it.
    return made.where(F.length("text") > F.least(F.col("block") * block, F.lit(left)))


class Cut:
    """The borders of one block: where a chunk can start, where it ends and where the next one starts.

    Pieces are those between blank lines, or where these are long, line ends, then blanks, then
    characters; pieces of one kind inside one longer piece make a run, and chunks are runs' pieces
    as far as they fit. A piece is long from ``size`` characters on, so only so many on both sides
    of a border bear on it. ``odd`` says that an odd number of line ends stands right before the
    text, since blank lines are paired off from the first line end on.
    """

    def __init__(self, text: str, number: int, odd: bool, size: int, overlap: int, block: int):
        self.text, left, right = text, size, 4 * size
        self.origin = max(number * block - left, 0)
        self.begin = number * block - self.origin
        self.end = min(self.begin + block, len(text))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        m = len(codes)
        at_end = m < self.begin + block + right
        line = codes == 10
        here = np.arange(m + 1)
        ahead = np.maximum.accumulate(np.where(line, -1, here[:m]))  # the last other character
        nth = here[:m] - ahead - 1 + (ahead < 0) * int(odd)
        paired = line & (nth % 2 == 0) & np.append(line[1:], False)
        # Line ends right before the place from which the next block looks.
        ask = (number + 1) * block - left - self.origin
        self.odd_next = bool(0 < ask <= m and line[ask - 1] and nth[ask - 1] % 2 == 0)

        borders, small = [], []
        cuts = np.zeros(m + 1, bool)
        cuts[0], cuts[m] = self.origin == 0, at_end
        for found in (paired, line, codes == 32):
            cuts = cuts.copy()
            cuts[:m] |= found
            before = np.maximum.accumulate(np.where(cuts, here, -_FAR))[:m]
            after = np.minimum.accumulate(np.where(cuts, here, _FAR)[::-1])[::-1][1:]
            borders.append(cuts)
            small.append(after - before < size)
        kind = np.select(small, [0, 1, 2], 3)
        mark = np.append(np.select([kind == 0, kind == 1, kind == 2], [b[:m] for b in borders], True), at_end)
        outer = np.select([kind == 1, kind == 2, kind == 3], [b[:m] for b in borders], False)
        joined = np.zeros(m + 1, bool)
        joined[1:m] = (kind[1:] == kind[:-1]) & ~outer[1:]

        marks = self.marks = np.flatnonzero(mark)
        self.low, self.high = np.searchsorted(marks, [self.begin, self.end]).tolist()
        own = np.arange(self.low, self.high)
        ends = np.append(np.flatnonzero(~joined[marks]), len(marks))
        run_end = ends[np.searchsorted(ends, own, side="right")]
        fits = np.maximum(np.searchsorted(marks, marks[own] + size, side="right") - 1, own + 1)
        self.last = np.minimum(fits, run_end)
        following = marks[np.minimum(self.last + 1, len(marks) - 1)]
        reach = np.maximum(marks[self.last] - overlap, following - size)
        again = np.minimum(np.searchsorted(marks, reach), self.last)
        self.next = np.where(self.last == run_end, self.last, again)
        seen = np.concatenate([[0], np.cumsum(~np.isin(codes, _BLANK))])
        self.full = seen[marks[self.last]] > seen[marks[own]]

    def function(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For a chunk that starts at each of the block's first ``size`` characters: how far behind
        the block the first one behind it starts, and how many chunks start inside."""
        jump = np.arange(len(self.marks))
        total = np.zeros(len(self.marks), np.int64)
        jump[self.low : self.high], total[self.low : self.high] = self.next, self.full
        while (jump[self.low : self.high] < self.high).any():
            total = total + total[jump]
            jump = jump[jump]
        to, n = np.zeros(size, np.int64), np.zeros(size, np.int64)
        entered = self.marks - self.begin
        valid = (entered >= 0) & (entered < size)
        to[entered[valid]] = self.marks[jump[valid]] - self.end
        n[entered[valid]] = total[valid]
        return np.clip(to, 0, size - 1), n

    def chunks(self, entry: int) -> Iterator[str]:
        """The chunks that start inside, the first of them ``entry`` characters behind the begin."""
        i = int(np.searchsorted(self.marks, self.begin + entry))
        while i < self.high:
            own = i - self.low
            if self.full[own]:
                yield self.text[self.marks[i] : self.marks[self.last[own]]].strip()
            i = int(self.next[own])


def entries(functions: DataFrame, states: int) -> DataFrame:
    """``doc, block, state, n``: where each block is entered, and the sum of ``n`` before it.

    ``functions`` has ``doc, block, to, n``: for each state at a block's begin the state at its end
    and a number. Up to :data:`GROUP` blocks are composed into one, until every document is one;
    then the states go down the same groups again. State 0 is where a document begins.
    """
    doc_type = functions.schema["doc"].dataType.simpleString()

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tos, ns = [], []
            for to, n in zip(batch["to"], batch["n"], strict=True):
                state, total = np.arange(states), np.zeros(states, np.int64)
                for t, k in zip(np.reshape(to, (-1, states)), np.reshape(n, (-1, states)), strict=True):
                    state, total = t[state], total + k[state]
                tos.append(state)
                ns.append(total)
            yield pd.DataFrame({"doc": batch["doc"], "block": batch["block"], "to": tos, "n": ns})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples():
                state, total, inside = int(row.state), int(row.total), []
                for b, t, k in zip(row.members, np.reshape(row.to, (-1, states)), np.reshape(row.n, (-1, states)), strict=True):
                    inside.append({"block": int(b), "state": state, "n": total})
                    state, total = int(t[state]), total + int(k[state])
                found.append(inside)
            yield pd.DataFrame({"doc": batch["doc"], "inside": found})

    level, groups = functions, []
    while level.agg(F.max("block")).first()[0]:
        members = F.array_sort(F.collect_list(F.struct("block", "to", "n")))
        group = F.floor(F.col("block") / GROUP).alias("block")
        grouped = level.groupBy("doc", group).agg(members.alias("m"))
        flat = [F.flatten(f"m.{c}").alias(c) for c in ("to", "n")]
        groups.append(checkpointed(grouped.select("doc", "block", F.col("m.block").alias("members"), *flat), "groups", ROWS))
        schema = f"doc {doc_type}, block long, to array<long>, n array<long>"
        level = checkpointed(groups[-1].drop("members").mapInPandas(compose, schema), "functions")
    zero = F.lit(0).cast("long")
    found = level.select("doc", "block", zero.alias("state"), zero.alias("n"))
    for group in reversed(groups):
        known = found.select(F.col("doc").alias("of"), F.col("block").alias("nth"), "state", F.col("n").alias("total"))
        met = group.join(known, F.col("doc").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nth")))
        met = met.select("doc", "members", "to", "n", "state", "total")
        schema = f"doc {doc_type}, inside array<struct<block: long, state: long, n: long>>"
        found = checkpointed(met.mapInPandas(enter, schema).select("doc", F.inline("inside")), "entries")
    return found


def chunk_parts(
    parts: DataFrame,
    doc: str = "doc_id",
    part: str = "part_no",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    block: int = BLOCK,
) -> DataFrame:
    """Separator-aware chunks of documents whose text is that of their parts in order; ``doc,
    chunk_no, text``, the same chunks as ``corpus.split_text`` of the whole text.

    No task holds more of a document than a block or a part, so parts may be as many as they like.
    Null and empty texts add nothing, a document without any text has no chunks, and a missing id is one document.
    Parts of the same number follow each other by the digest of their text. Texts shuffle three
    times: to their range, to their block, and to the place where the block is entered.
    """
    if not 0 <= overlap < size or block < 1:
        raise ValueError("overlap must be smaller than size, and block positive")
    doc_type = parts.schema[doc].dataType.simpleString()
    cut = checkpointed(blocks(with_offsets(parts, doc, part, text), block, size, 4 * size), "blocks", ROWS)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tos, ns = [], []
            for number, whole in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                halves, counts = [], []
                for odd in (False, True):  # the same unless the text begins with a line end
                    if not odd or whole[0] == "\n":
                        one = Cut(whole, number, odd, size, overlap, block)
                        to, n = one.function(size)
                    halves.append(to + size * one.odd_next)
                    counts.append(n)
                tos.append(np.concatenate(halves))
                ns.append(np.concatenate(counts))
            made = [pa.array(a, pa.list_(pa.int64())) for a in (tos, ns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("block"), *made], ["doc", "block", "to", "n"])

    functions = cut.mapInArrow(sum_up, f"doc {doc_type}, block long, to array<long>, n array<long>")
    places = entries(checkpointed(functions, "functions"), 2 * size)
    places = places.select(F.col("doc").alias("of"), F.col("block").alias("nth"), "state", "n")
    met = cut.join(places, F.col("doc").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nth")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                list(Cut(whole, number, state >= size, size, overlap, block).chunks(state % size))
                for number, whole, state in zip(*(batch.column(c).to_pylist() for c in ("block", "text", "state")), strict=True)
            ]
            made = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n"), made], ["doc", "n", "chunks"])

    chunks = met.select("doc", "block", "text", "state", "n").mapInArrow(split, f"doc {doc_type}, n long, chunks array<string>")
    chunks = chunks.select("doc", "n", F.posexplode("chunks").alias("nth", "chunk"))
    return chunks.select(F.col("doc").alias(doc), (F.col("n") + F.col("nth")).alias("chunk_no"), F.col("chunk").alias("text"))
