"""Records of JSON files that are one list, read in many tasks.

A file is read as the pieces between its commas, which Spark splits by bytes like lines. What a comma
means depends on all that stands before it, so every split is first summed up as a function of the
state it begins in: inside a string or not, and how deep in brackets. These functions are composed
over a file's splits, and each split is then cut where a record ends. What is left at its ends is
put together with its neighbours'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.DOTALL)
BRACKET = re.compile(r"[\[\]{}]")
DATA_KEY = re.compile(r'"data"\s*\Z')
OPENING = "[{"

#: Depth at which the records of a layout stand.
DEPTHS = {"list": 1, "wrapped": 2}


class Start(NamedTuple):
    """The state that a split begins in; ``inside`` says whether the list of records is open."""

    string: bool
    depth: int
    inside: bool = False


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, piece``: what stands between commas, in the order of the file within a split."""
    text = spark.read.option("lineSep", ",").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("piece"))


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """Runs of pieces of one split, as far as a batch holds them."""
    for batch in batches:
        files, splits, values = (batch.column(i).to_pylist() for i in range(3))
        begin = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], splits[i]) != (files[begin], splits[begin]):
                yield files[begin], splits[begin], values[begin:i]
                begin = i


def plain(piece: str) -> str:
    """The piece, with as many other characters for each escaped one."""
    return ESCAPED.sub("__", piece) if "\\" in piece else piece


def nesting(text: str) -> int:
    return text.count("[") + text.count("{") - text.count("]") - text.count("}")


def effect(piece: str) -> tuple[bool, int, int]:
    """Whether a piece has an odd number of quotes, and what it adds to the depth if it begins
    outside and if it begins inside a string."""
    parts = plain(piece).split('"')
    return len(parts) % 2 == 0, sum(map(nesting, parts[::2])), sum(map(nesting, parts[1::2]))


def brackets(piece: str, string: bool) -> Iterator[tuple[int, str]]:
    """Places and kinds of the brackets outside of strings."""
    at = 0
    for part in plain(piece).split('"'):
        if not string:
            for found in BRACKET.finditer(part):
                yield at + found.start(), found[0]
        string = not string
        at += len(part) + 1


def split_starts(parts: DataFrame) -> dict[tuple[str, int], Start]:
    """The state in which each split begins, by file and place; a few numbers a split."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for file, split, values in by_split(batches):
            odd, outside, inside = found.get((file, split), (False, 0, 0))
            for value in values:
                flips, out, within = effect(value)
                # A split that began outside is now inside a string if it has had an odd number of quotes.
                outside, inside = (outside + within, inside + out) if odd else (outside + out, inside + within)
                odd ^= flips
            found[file, split] = [odd, outside, inside]
        rows = [(*key, *value) for key, value in found.items()]
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["file", "split", "odd", "outside", "inside"])

    sums = parts.mapInArrow(sum_up, "file string, split long, odd boolean, outside long, inside long").collect()
    starts: dict[tuple[str, int], Start] = {}
    file, string, depth = None, False, 0
    for row in sorted(sums, key=lambda r: (r.file, r.split)):
        if row.file != file:
            file, string, depth = row.file, False, 0
        starts[row.file, row.split] = Start(string, depth)
        depth += row.inside if string else row.outside
        string ^= row.odd
    return starts


def layouts(parts: DataFrame, starts: dict[tuple[str, int], Start]) -> tuple[dict[str, str], dict[tuple[str, int], Start]]:
    """The layout of each file, and starts that know where a wrapped list is open.

    A file that is one list or one object is read as such; an object holds its records under
    ``data``. Anything else has one record a line.
    """
    held = parts.sparkSession.sparkContext.broadcast(starts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list] = {}
        for file, split, values in by_split(batches):
            own = states.get((file, split))
            if own is None:
                start = held.value[file, split]
                own = states[file, split] = [start.string, start.depth, 0, "", False, -1]
            string, depth, values_ended, first, stray, opens = own
            for value in values:
                if not first and (lead := value.lstrip("\ufeff \t\r\n")):
                    first = lead[0]
                last = 0
                for at, kind in brackets(value, string):
                    if not depth and value[last:at].strip("\ufeff \t\r\n"):
                        stray = True
                    if kind in OPENING:
                        depth += 1
                        if depth == 2 and kind == "[":
                            key = DATA_KEY.search(value[:at].rstrip().removesuffix(":"))
                            opens = 1 if key else 0
                    else:
                        depth -= 1
                        if depth == 1:
                            opens = 0
                        values_ended += depth == 0
                    last = at + 1
                string ^= effect(value)[0]
                if not depth and not string and value[last:].strip():
                    stray = True
            states[file, split] = [string, depth, values_ended, first, stray, opens]
        rows = [(*key, *value[2:]) for key, value in states.items()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["file", "split", "ended", "first", "stray", "opens"])

    seen = parts.mapInArrow(look, "file string, split long, ended long, first string, stray boolean, opens long").collect()
    made: dict[str, list] = {}
    known, inside, file = {}, False, None
    for row in sorted(seen, key=lambda r: (r.file, r.split)):
        if row.file != file:
            file, inside = row.file, False
        ended, first, stray = made.setdefault(row.file, [0, "", False])
        made[row.file] = [ended + row.ended, first or row.first, stray or row.stray]
        known[row.file, row.split] = starts[row.file, row.split]._replace(inside=inside)
        inside = inside if row.opens < 0 else bool(row.opens)
    kinds = {"[": "list", "{": "wrapped"}
    found = {f: kinds.get(first, "lines") if ended == 1 and not stray else "lines" for f, (ended, first, stray) in made.items()}
    return found, known


class Cutter:
    """Cuts the pieces of one split into records of a layout."""

    def __init__(self, layout: str, start: Start):
        self.level = DEPTHS[layout]
        self.string, self.depth = start.string, start.depth
        self.inside = start.depth >= self.level and (layout == "list" or start.inside)
        # A split begins with the rest of a record, unless it begins right behind one.
        self.whole = not self.inside or (not start.string and start.depth == self.level)
        self.held: list[str] = []

    def ended(self) -> tuple[bool, bool, str]:
        """``whole, ends, text`` of what is held; the next record begins."""
        row = (self.whole, True, ",".join(self.held))
        self.held, self.whole = [], True
        return row

    def add(self, piece: str) -> Iterator[tuple[bool, bool, str]]:
        flips, outside, within = effect(piece)
        depth = self.depth + (within if self.string else outside)
        if self.inside and depth >= self.level:
            self.held.append(piece)
        else:
            yield from self.crossed(piece)
        self.depth, self.string = depth, self.string ^ flips
        if self.inside and not self.string and depth == self.level:
            yield self.ended()

    def crossed(self, piece: str) -> Iterator[tuple[bool, bool, str]]:
        """A piece in which the list begins or ends."""
        depth, begin = self.depth, 0
        for at, kind in brackets(piece, self.string):
            depth += 1 if kind in OPENING else -1
            if not self.inside and kind == "[" and depth == self.level:
                if self.level == 1 or DATA_KEY.search(piece[:at].rstrip().removesuffix(":")):
                    self.inside, begin = True, at + 1
            elif self.inside and depth == self.level - 1:
                self.held.append(piece[begin:at])
                self.inside = False
                yield self.ended()
        if self.inside:
            self.held.append(piece[begin:])


def list_records(parts: DataFrame, layout: dict[str, str], starts: dict[tuple[str, int], Start]) -> DataFrame:
    """``record``, the text of each element of the lists; files that are ``lines`` are passed over.

    Both readings of the files must split them alike, or this fails.
    """
    held = parts.sparkSession.sparkContext.broadcast((layout, starts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, nth, rows = None, None, 0, []

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["file", "split", "nth", "whole", "ends", "record"])

        def rest() -> None:
            if cutter and cutter.held:
                rows.append((*key, 1, False, False, ",".join(cutter.held)))

        kinds, begins = held.value
        for file, split, values in by_split(batches):
            if kinds[file] not in DEPTHS:
                continue
            if (file, split) != key:
                rest()
                if (file, split) not in begins:
                    raise ValueError(f"{file} was split otherwise before; the session's file settings or its cores have changed")
                key, cutter = (file, split), Cutter(kinds[file], begins[file, split])
            for value in values:
                rows += [(*key, 0, *row) for row in cutter.add(value)]
            yield batch()
        rest()
        yield batch()

    schema = "file string, split long, nth long, whole boolean, ends boolean, record string"
    rows = parts.mapInArrow(cut, schema)
    # At most two rows for each split are no whole records.
    ends = rows.where("not whole")
    order = Window.partitionBy("file").orderBy("split", "nth")
    before = F.sum(F.col("ends").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("one", F.coalesce(before, F.lit(0)))
    glued = ends.groupBy("file", "one").agg(F.sort_array(F.collect_list(F.struct("split", "nth", "record"))).alias("parts"))
    glued = glued.select(F.array_join("parts.record", ",").alias("record"))
    records = rows.where("whole").select("record").union(glued)
    records = records.select(F.btrim("record", F.lit(" \t\r\n")).alias("record"))
    return records.where("record != ''")


def read_lists(spark: SparkSession, path: str | list[str], layout: str) -> DataFrame:
    """``record`` of files that are all of layout ``list``, or all ``wrapped`` as ``{"data": [...]}``."""
    parts = pieces(spark, path)
    starts = split_starts(parts)
    if layout == "wrapped":
        starts = layouts(parts, starts)[1]
    return list_records(parts, {file: layout for file, _ in starts}, starts)


def read_any(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record`` of files whose layout is found out, of each on its own."""
    parts = pieces(spark, path)
    found, starts = layouts(parts, split_starts(parts))
    lines = [file for file, layout in found.items() if layout == "lines"]
    records = spark.createDataFrame([], "record string") if len(lines) == len(found) else list_records(parts, found, starts)
    if not lines:
        return records
    rest = spark.read.text(lines).select(F.col("value").alias("record"))
    return records.union(rest.where(F.trim("record") != ""))
