"""Benchmark decontamination by a positional inverted index.

All words of the training documents are stored with their positions, by shards of about a megabyte of
text: sorted terms, where each term's postings end, and the postings. The index knows nothing of a
benchmark, so it is built once and any number of them can ask it. A phrase is looked up from its
rarest term: the postings of that term, shifted by its offset, are intersected with the shifted
postings of the next rarest one, and so on. Benchmarks larger than a block are searched block by
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm.line_dedup import line_key
from sumwright.llm.shared import col, materialize, packed, unpacked

WINDOW = 10
#: Characters of benchmark text that the driver holds and sends out at a time.
BLOCK_CHARS = 2 * 2**20
#: Bytes of text that are taken apart at a time; a longer document is taken alone.
CHUNK = 2**20
#: Shards of a row group; a task reads these at once.
SHARDS = 4
#: Candidates that are checked at a time.
CANDIDATES = 2**20

# A byte of a word as it counts, 0 between words: digits, letters in lower case, all of non-ASCII.
FOLDED = np.zeros(256, np.uint8)
for _low, _high, _shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x41, 0x5A, 32), (0x80, 0xFF, 0)):
    FOLDED[_low : _high + 1] = np.arange(_low, _high + 1) + _shift if _high < 0xFF else np.arange(128, 256)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. UTF-8
    keeps bytes beyond 127 for those characters, so bytes are looked up instead of characters.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    # A byte between words after every text keeps words of two texts apart.
    data = FOLDED[np.frombuffer(b"\0".join(texts.to_pylist()) + b"\0", np.uint8)]
    inside = data != 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    counts = np.diff(np.searchsorted(starts, bounds))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = data[inside]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )
    return words, counts


def chunks(batch: pa.RecordBatch, size: pa.Array, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes, or one row."""
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


class Phrases:
    """The windows of a block of items over the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words, counts = words_of(pa.array([text for _, text in items], pa.large_string()))
        self.vocabulary = pc.unique(words)
        ids = pc.index_in(words, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32)
        rows: dict[bytes, int] = {}
        of_item: dict[int, set[int]] = {}
        terms, at = [], 0
        for item, n in enumerate(counts.tolist()):
            for start in range(max(n - window + 1, min(n, 1))):
                phrase = ids[at + start : at + min(start + window, n)]
                row = rows.setdefault(phrase.tobytes(), len(rows))
                if row == len(terms):
                    terms.append(phrase)
                of_item.setdefault(row, set()).add(item)
            at += n
        self.names = [name for name, _ in items]
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.terms = np.full((len(terms), window), -1, np.int32)
        for row, phrase in enumerate(terms):
            self.terms[row, : len(phrase)] = phrase
        pairs = sorted((row, item) for row, of in of_item.items() for item in of)
        self.item = np.array([item for _, item in pairs], np.int64)
        self.item_ends = np.searchsorted(np.array([row for row, _ in pairs], np.int64), np.arange(len(terms)), "right")


# The index


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``shard, doc_ids, n_words, terms, ends, places``: the postings of all words, by shard.

    The words of a shard's documents are numbered one after another. ``terms`` are its distinct words
    in order; the numbers of the ``k``-th lie in ``places`` from ``ends[k - 1]`` to ``ends[k]``. Written,
    so that a shard keeps its number. Null texts have no words.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            for part in chunks(batch, sizes):
                words, counts = words_of(part.column("text"))
                coded = words.dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                term = rank[coded.indices.to_numpy(zero_copy_only=False)]
                ends = np.cumsum(np.bincount(term, minlength=len(order))).astype(np.int32)
                places = np.argsort(term, kind="stable").astype(np.int32)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                terms = coded.dictionary.take(pa.array(order)).cast(pa.binary())
                lists = [part.column("doc_id"), pa.array(counts.astype(np.int64)), terms, pa.array(ends), pa.array(places)]
                yield pa.RecordBatch.from_arrays([one(x) for x in lists], ["doc_ids", "n_words", "terms", "ends", "places"])

    schema = f"doc_ids array<{kind}>, n_words array<long>, terms array<binary>, ends array<int>, places array<int>"
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).mapInArrow(post, schema)
    return materialize(rows.select(F.monotonically_increasing_id().alias("shard"), "*"), "postings", SHARDS)


# Search


def shard_postings(shard: dict[str, pa.Array], vocabulary: pa.Array, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, by their number in a vocabulary, and places of its postings in a shard, sorted by both,
    and where each document begins.

    Documents lie one after another with ``gap`` empty places between.
    """
    n_words = shard["n_words"].to_numpy(zero_copy_only=False)
    plain = np.cumsum(n_words) - n_words
    begin = plain + gap * np.arange(len(n_words))
    found = pc.index_in(vocabulary.cast(pa.binary()), shard["terms"])
    known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)[known]
    ends = shard["ends"].to_numpy()
    counts = np.diff(ends, prepend=0)[at]
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = shard["places"].to_numpy()[np.repeat(ends[at] - counts, counts) + nth].astype(np.int64)
    # Of documents that begin at one place all but the last have no words.
    doc = np.searchsorted(plain, place, "right") - 1
    return np.repeat(known, counts).astype(np.int64), place + gap * doc, begin


def phrase_matches(term: np.ndarray, place: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(phrase, first place)`` of all exact matches, some phrases at a time.

    The terms of a phrase are taken from the rarest in this shard to the most frequent. Each one's
    postings, shifted by its offset, are intersected with what is left.
    """
    n = len(phrases.vocabulary)
    width = int(place.max()) + 1 if len(place) else 1
    starts = np.searchsorted(term, np.arange(n + 1))
    count = np.diff(starts)
    sought = np.where(phrases.terms < 0, np.iinfo(np.int64).max, count[phrases.terms])
    order = np.argsort(sought, axis=1, kind="stable")
    rarest = np.take_along_axis(sought, order[:, :1], 1)[:, 0] if len(sought) else np.zeros(0, np.int64)
    live = np.flatnonzero(rarest > 0)
    keys = term * width + place
    total = np.cumsum(rarest[live])
    at = 0
    while at < len(live):
        base = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, base + CANDIDATES, "right")), at + 1)
        rows = np.repeat(live[at:to], rarest[live[at:to]])
        lead = phrases.terms[rows, order[rows, 0]]
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(rarest[live[at:to]]) - rarest[live[at:to]], rarest[live[at:to]])
        begin = place[starts[lead] + nth] - order[rows, 0]
        for rank in range(1, phrases.terms.shape[1]):
            if not len(rows):
                break
            offset = order[rows, rank]
            wanted = phrases.terms[rows, offset]
            key = wanted.astype(np.int64) * width + begin + offset
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            inside = (begin + offset >= 0) & (begin + offset < width)
            hit = (wanted < 0) | (inside & (keys[where] == key))
            rows, begin = rows[hit], begin[hit]
        yield rows, begin
        at = to


def near_matches(term: np.ndarray, place: np.ndarray, phrases: Phrases, slack: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(phrase, first places, last places)`` of words in order with up to ``slack`` others between two.

    From the first term on, a posting stays if one of the term before that stayed lies close enough
    before it; it carries the latest first place it can be reached from.
    """
    starts = np.searchsorted(term, np.arange(len(phrases.vocabulary) + 1))
    for row, length in enumerate(phrases.lengths.tolist()):
        wanted = phrases.terms[row, :length]
        if (np.diff(starts)[wanted] == 0).any():
            continue
        last = place[starts[wanted[0]] : starts[wanted[0] + 1]]
        first = last
        for t in wanted[1:]:
            own = place[starts[t] : starts[t + 1]]
            before = np.searchsorted(last, own) - 1
            near = (before >= 0) & (own - last[np.maximum(before, 0)] <= slack + 1) if len(last) else np.zeros(len(own), bool)
            first, last = first[before[near]], own[near]
        if len(last):
            yield row, first, last


def ask(
    index: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    slack: int = 0,
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, spans`` of every document of an index; ``spans`` are ``start, end, item_id, exact``.

    An item's windows are ``window`` words in a row, or all its words if it has fewer. A span is an
    occurrence of a window, from word ``start`` up to before ``end``. With ``slack`` above 0 windows
    whose words follow each other with up to that many other words between two are found as well,
    the shortest span for each last word; these are not ``exact``. Spans are in order of place.

    Null texts have no words; items without words have no windows. Repeated documents give repeated
    rows, items that repeat an id are searched each, and a null item id stays null in its spans.
    """
    spark, found, blocks = index.sparkSession, None, 0
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    spans = "array<struct<start:int,end:int,item_id:string,exact:boolean>>"
    for block in _blocks(items, item_id, item_text):
        phrases = spark.sparkContext.broadcast(Phrases(block, window))

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    shard = {name: batch.column(name)[row].values for name in ("doc_ids", "n_words", "terms", "ends", "places")}
                    yield _search(batch.column("shard")[row].as_py(), shard, phrases.value, slack)

        here = index.mapInArrow(search, f"shard long, nth int, doc_id {kind}, n_words long, spans {spans}")
        found, blocks = here if found is None else found.union(here), blocks + 1
    if blocks > 1:
        # A row of each block for every document.
        merged = F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
        found = found.groupBy("shard", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged)
    return found.drop("shard", "nth")


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """:func:`ask` of an index that is built for it."""
    return ask(build_index(docs, doc_id, text), items, **options)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated``: what :func:`matches` finds exactly.

    ``n_hit`` counts the words inside any span, ``items`` are the distinct ids in string order
    without null, ``n_items`` their number. A document is contaminated if a word is hit.
    """
    exact = F.filter("spans", lambda s: s.exact)

    def add(done: Column, span: Column) -> Column:
        fresh = F.greatest(span.end - F.greatest(done.end, span.start), F.lit(0))
        return F.struct(F.greatest(done.end, span.end).alias("end"), (done.n + fresh).alias("n"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n_hit = F.aggregate(exact, start, add, lambda done: done.n.cast("long"))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(exact, lambda s: s.item_id), lambda i: i.isNotNull())))
    found = matches(docs, items, **options).select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows without any exact match, with the columns of ``docs``; null texts stay.

    Equal texts match alike, so a hash of the text tells which rows go.
    """
    key = F.coalesce(line_key(col(text)), F.lit(""))
    keyed = docs.select(key.alias("key"), col(text).alias("text"))
    found = contamination(keyed, items, doc_id="key", text="text", **options)
    dirty = materialize(found.where("contaminated").select(F.col("doc_id").alias("dirty")).distinct(), "dirty")
    rows = packed(docs, key=key).join(dirty, F.col("key") == F.col("dirty"), "left_anti")
    return unpacked(rows, docs)


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of :data:`BLOCK_CHARS` characters, or one item; one empty block if none."""
    block, size, any_block = [], 0, False
    for item in items.select(col(item_id).cast("string"), F.coalesce(col(item_text), F.lit(""))).toLocalIterator():
        if block and size + len(item[1]) > BLOCK_CHARS:
            yield block
            block, size, any_block = [], 0, True
        block.append((item[0], item[1]))
        size += len(item[1])
    if block or not any_block:
        yield block


def _search(number: int, shard: dict[str, pa.Array], phrases: Phrases, slack: int) -> pa.RecordBatch:
    gap = phrases.terms.shape[1] + slack * phrases.terms.shape[1] + 1
    term, place, begin = shard_postings(shard, phrases.vocabulary, gap)
    rows, first, last, exact = [], [], [], []
    if len(phrases.terms) and len(term):
        for row, at in phrase_matches(term, place, phrases):
            rows.append(row)
            first.append(at)
            last.append(at + phrases.lengths[row])
            exact.append(np.ones(len(row), bool))
        for row, at, to in near_matches(term, place, phrases, slack) if slack else ():
            loose = to - at >= phrases.lengths[row]
            rows.append(np.full(int(loose.sum()), row))
            first.append(at[loose])
            last.append(to[loose] + 1)
            exact.append(np.zeros(int(loose.sum()), bool))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    rows, first, last, exact = join(rows, np.int64), join(first, np.int64), join(last, np.int64), join(exact, bool)
    # A phrase of several items is a span of each.
    of = phrases.item_ends
    copies = np.diff(of, prepend=0)[rows] if len(of) else np.zeros(0, np.int64)
    spread = np.repeat(np.arange(len(rows)), copies)
    nth = np.arange(len(spread)) - np.repeat(np.cumsum(copies) - copies, copies)
    items = phrases.item[(of[rows] - copies)[spread] + nth] if len(spread) else np.zeros(0, np.int64)
    first, last, exact = first[spread], last[spread], exact[spread]
    doc = np.searchsorted(begin, first, "right") - 1
    order = np.lexsort((items, last, first, doc))
    doc, first, last, items, exact = (x[order] for x in (doc, first, last, items, exact))
    spans = pa.StructArray.from_arrays(
        [
            pa.array((first - begin[doc]).astype(np.int32)),
            pa.array((last - begin[doc]).astype(np.int32)),
            pa.array([phrases.names[i] for i in items.tolist()], pa.string()),
            pa.array(exact),
        ],
        ["start", "end", "item_id", "exact"],
    )
    n = len(shard["doc_ids"])
    cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    own = [pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n, dtype=np.int32)), shard["doc_ids"], shard["n_words"]]
    return pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(cuts, spans)], ["shard", "nth", "doc_id", "n_words", "spans"])
