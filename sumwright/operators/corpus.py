"""Documents: page assembly, chunks, chunk collection, question-answer pairs, term statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwright.functions.prompts import excerpt
from sumwright.functions.quality import terms
from sumwright.functions.text import bind
from sumwright.session import checkpointed

CHUNK_SIZE, CHUNK_OVERLAP = 200, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def assemble_pages(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text"
) -> DataFrame:
    """Pages → one text per document: pages in order, empty ones skipped, each ended by a newline.

    A group is one document, which its own output row has to hold anyway.
    """
    kept = pages.where(F.col(text) != "")
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    texts = F.transform(ordered, lambda p: p[text])
    return kept.groupBy(doc).agg(F.concat(F.array_join(texts, "\n"), F.lit("\n")).alias("text"))


def chunk_fixed(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; ``doc, chunk_no, text``.

    The text is cut into steps in one pass and each window is a step plus the start of the next, so
    the cost is linear in the length of a document; taking substrings by position is not.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must be at most half of size")

    def windows(steps: Column) -> Column:
        def window(piece: Column, i: Column) -> Column:
            following = F.substring(F.get(steps, i + 1), 1, overlap)
            return F.concat(piece, F.coalesce(following, F.lit("")))

        return F.transform(steps, window)

    steps = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return docs.select(doc, F.posexplode(bind(steps, windows)).alias("chunk_no", "text"))


def _cut_points(text: str, separators: tuple[str, ...], size: int) -> list[Sequence[int]]:
    """Runs of piece borders. Pieces in one run may be merged; runs are never merged together."""
    separator = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(separator) + 1 :] if separator in separators else ()
    if separator == "":
        return [range(len(text) + 1)]
    borders = [0]
    at = text.find(separator)
    while at >= 0:
        if at > 0:
            borders.append(at)
        at = text.find(separator, at + len(separator))
    borders.append(len(text))
    runs, run = [], [0]
    for start, end in zip(borders, borders[1:]):
        if end - start < size or not rest:
            run.append(end)
            continue
        if len(run) > 1:
            runs.append(run)
        inner = _cut_points(text[start:end], rest, size)
        runs.extend([start + b for b in r] for r in inner)
        run = [end]
    if len(run) > 1:
        runs.append(run)
    return runs


def _merge_run(borders: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy chunks over one run: as many pieces as fit, then back up to ``overlap``."""
    marks = np.asarray(borders)
    first, end = 0, len(marks) - 1
    while True:
        last = max(int(np.searchsorted(marks, marks[first] + size, side="right")) - 1, first + 1)
        yield borders[first], borders[last]
        if last >= end:
            return
        # The next chunk starts so that it repeats at most ``overlap`` and still fits its new piece.
        reach = max(marks[last] - overlap, marks[last + 1] - size)
        first = min(int(np.searchsorted(marks, reach, side="left")), last)


def split_text(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> list[str]:
    """Chunks of one text: cut at the coarsest separator present, finer ones for long pieces."""
    if not text:
        return []
    spans = (
        span
        for run in _cut_points(text, separators, size)
        for span in _merge_run(run, size, overlap)
    )
    chunks = (text[start:end].strip() for start, end in spans)
    return [chunk for chunk in chunks if chunk]


def chunk_recursive(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Separator-aware chunks; ``doc, chunk_no, text``. Each document is cut on its own, in Arrow
    batches; nothing shuffles."""
    doc_type = docs.schema[doc].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [split_text(t or "", size, overlap) for t in batch[text]]
            yield pd.DataFrame({doc: batch[doc], "chunks": pieces})

    split = docs.select(doc, text).mapInPandas(cut, f"`{doc}` {doc_type}, chunks array<string>")
    return split.select(doc, F.posexplode("chunks").alias("chunk_no", "text"))


def chunk_records(chunks: DataFrame, doc: str = "doc_id", source: str | None = None) -> DataFrame:
    """Chunks as collection records ``id, text, metadata``; equal chunks get equal ids and one record.

    Only ids are shuffled, to find those that repeat; their records, usually none, are then
    reduced to one each.
    """
    origin = F.col(doc).cast("string") if source is None else F.lit(source)
    key = F.concat_ws("|", F.col(doc).cast("string"), F.col("chunk_no").cast("string"), "text")
    records = chunks.select(
        F.sha2(key, 256).alias("id"),
        "text",
        F.create_map(F.lit("source"), origin).alias("metadata"),
    )
    repeated = records.groupBy("id").agg(F.count("*").alias("__n")).where("__n > 1").select("id")
    repeated = checkpointed(repeated)
    once = records.join(repeated, "id", "left_anti")
    return once.unionByName(records.join(repeated, "id", "left_semi").dropDuplicates(["id"]))


def following(turns: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """``conv, turn, role`` with ``next_turn`` and ``next_role`` of the same conversation.

    Turns are sorted over all conversations and cut into ranges of rows, so a conversation of any
    size is spread over many tasks. The last turn of a range continues with the first of the next
    range that has rows; there is one such row for each range.
    """
    ranges = turns.select(conv, turn, role).repartitionByRange(conv, turn, role)
    ranges = checkpointed(ranges.withColumn("__range", F.spark_partition_id()))
    order = [F.col(c) for c in (conv, turn, role)]
    inside = Window.partitionBy("__range").orderBy(*order)
    here = ranges.withColumn("__next", F.lead(F.struct(*order)).over(inside))
    firsts = ranges.groupBy("__range").agg(F.min(F.struct(*order)).alias("__first"))
    later = firsts.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__later"))
    joined = here.join(F.broadcast(later), "__range")
    after = F.coalesce("__next", "__later")
    same = after[conv].eqNullSafe(F.col(conv))
    return joined.select(
        *order,
        F.when(same, after[turn]).alias("next_turn"),
        F.when(same, after[role]).alias("next_role"),
    )


def conversation_pairs(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    length: int = 100,
) -> DataFrame:
    """User turns whose next turn is an assistant's: ``conv, turn, question, answer, context, source``.

    Turn numbers order a conversation and may have gaps. Only they are sorted; texts shuffle once,
    to meet by conversation and turn, a key as fine as the rows. ``context`` is the whole text asked
    about, ``source`` its first ``length`` characters, kept as a reference.
    """
    after = following(turns, conv, turn, role)
    wanted = after.where((F.col(role) == "user") & (F.col("next_role") == "assistant"))
    wanted = wanted.select(conv, turn, F.col("next_turn").alias("__at"))
    asked = turns.where(F.col(role) == "user").select(conv, turn, F.col(text).alias("question"))
    answered = turns.where(F.col(role) == "assistant").select(
        conv, F.col(turn).alias("__at"), F.col(text).alias("answer")
    )
    met = asked.join(wanted, [conv, turn]).join(answered, [conv, "__at"])
    context = F.col("question").alias("context")
    source = excerpt(F.col("question"), length).alias("source")
    return met.select(conv, turn, "question", "answer", context, source)


def term_counts(df: DataFrame, *texts: str | Column) -> DataFrame:
    """``term, n`` over all words of the given text columns; counted partially before the shuffle."""
    columns = [F.col(t) if isinstance(t, str) else t for t in texts]
    exploded = df.select(F.explode(terms(*columns)).alias("term"))
    return exploded.groupBy("term").agg(F.count("*").alias("n"))


def term_stats(counts: DataFrame) -> DataFrame:
    """Number of distinct terms and of words, from term counts."""
    return counts.agg(
        F.count("*").alias("unique_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")
    )


def top_terms(counts: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent terms, ties by term."""
    return counts.orderBy(F.desc("n"), "term").limit(k)
