"""Line dedup by site-relative frequency.

Pages are grouped by site, the pages holding a line are divided by the site's pages, and lines
above a ratio are dropped. DataFrame functions only; neither texts nor lines are gathered by site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize, packed, unpacked

RATIO = 0.05
#: Pages that make a line a repeated one; beyond that the ratio alone decides.
MIN_PAGES = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def bare(line: Column) -> Column:
    """A line as it is compared: without blanks, tabs and returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def line_key(line: Column) -> Column:
    """128 bits of a line's content, as text."""
    return F.concat_ws(":", F.xxhash64(line), F.xxhash64(F.lit(1), line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, keys`` of rows ``site, text``: the keys of the lines to drop, for sites that have any.

    A line counts once a page, blank lines never. A line goes if more than ``ratio`` of the site's
    pages and at least ``min_pages`` of them hold it. Pages without text count as pages. The keys of
    one site are at most its mean number of lines a page divided by ``ratio``.
    """
    distinct = F.array_distinct(F.transform(lines_of(F.col("text")), bare))
    lines = pages.select("site", F.explode(distinct).alias("line")).where("line != ''")
    counts = lines.groupBy("site", line_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    totals = totals.select(F.col("site").alias("of"), "pages")
    frequent = counts.where(F.col("n") >= min_pages)
    frequent = frequent.join(totals, F.col("site").eqNullSafe(F.col("of")))
    frequent = frequent.where(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    return frequent.groupBy("site").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    docs: DataFrame,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    site: str = "source",
    text: str = "text",
) -> DataFrame:
    """All rows, texts without the lines frequent on their site, with ``n_lines`` and ``n_dropped``.

    ``site`` is the column of the host. Rows with a null site are one site. Null texts stay null
    with no lines, the empty text is one blank line. Blank lines stay. A page of which nothing but
    blank lines would be left is kept whole, since then the page itself is what is repeated.
    The result's columns replace those of the same name.
    """
    pages = docs.select(col(site).alias("site"), col(text).alias("text"))
    keys = materialize(boilerplate(pages, ratio, min_pages), "boilerplate").withColumnRenamed("site", "of")
    rows = packed(docs, site=col(site), text=col(text))
    rows = rows.join(keys, F.col("site").eqNullSafe(F.col("of")), "left")
    rows = rows.withColumn("lines", lines_of(F.col("text")))
    kept = F.filter("lines", lambda x: ~F.array_contains("keys", line_key(bare(x))))
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(kept)
    rows = rows.withColumn("kept", kept)
    left = F.exists("kept", lambda x: bare(x) != "")
    whole = F.size("kept") == F.size("lines")
    rows = rows.withColumn("kept", F.when(whole | left, F.col("kept")).otherwise(F.col("lines")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept"))
    return unpacked(
        rows,
        docs,
        **{text: F.array_join("kept", "\n")},
        n_lines=n_lines.cast("long"),
        n_dropped=(n_lines - n_kept).cast("long"),
    )
