"""Vocabulary, encoding, collation and validation of token arrays."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwright.functions.packing import IGNORE_LABEL, bad_input_ids, bad_labels, pad_ids
from sumwright.operators.sample import with_position
from sumwright.session import checkpointed

# Ids that no term gets: padding, and words outside the vocabulary.
PAD_ID, UNKNOWN_ID, RESERVED = 0, 1, 2

# Most frequent terms, of at most this many characters each, that all executors hold.
HEAD_TERMS = 50_000
_LONGEST_KEY = 64


def build_vocab(counts: DataFrame, reserved: int = RESERVED) -> DataFrame:
    """Term counts → ``term, n, token_id``: dense ids by falling count, ties in hash order.

    Ranks are offsets plus row numbers: terms are counted per (count, hash bucket), the offsets
    accumulate over these groups, and only rows of one group are sorted together. The many terms
    of count one are spread over 4,096 buckets.
    """
    keyed = counts.withColumn("__key", F.md5("term")).withColumn(
        "__bucket", F.substring("__key", 1, 3)
    )
    groups = keyed.groupBy("n", "__bucket").agg(F.count("*").alias("size"))
    # Distinct counts: with N words there are fewer than sqrt(2 N) of them.
    levels = groups.groupBy("n").agg(F.sum("size").alias("level_size"))
    higher = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("above", F.coalesce(F.sum("level_size").over(higher), F.lit(0)))
    before = Window.partitionBy("n").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.join(levels, "n").select(
        "n",
        "__bucket",
        (F.col("above") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("offset"),
    )
    inside = Window.partitionBy("n", "__bucket").orderBy("__key", "term")
    rank = F.col("offset") + F.row_number().over(inside) - 1 + reserved
    return keyed.join(offsets, ["n", "__bucket"]).select("term", "n", rank.alias("token_id"))


def _join_key(term: Column) -> Column:
    """The term, or its digest when it is long: keys have a bounded size."""
    return F.when(F.length(term) <= _LONGEST_KEY, term).otherwise(
        F.concat(F.lit("\x00"), F.sha2(term, 256))
    )


def _key_of(term: str) -> str:
    """``_join_key`` of one term."""
    return term if len(term) <= _LONGEST_KEY else "\x00" + hashlib.sha256(term.encode()).hexdigest()


def encode(
    df: DataFrame,
    id_col: str,
    tokens: Column,
    vocab: DataFrame,
    out: str = "ids",
    unknown: int = UNKNOWN_ID,
    reserved: int = RESERVED,
    head: int = HEAD_TERMS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, *keep, ids`` of every row: token arrays as id arrays; terms outside the vocabulary
    become ``unknown``.

    Rows stay rows, whatever their ids are. Frequent terms, at most ``head`` short keys with ids
    from ``reserved`` on, are looked up inside the row. Only the distinct other terms of a row
    shuffle, to meet the rest of the vocabulary, and come back as one small list.
    """
    keys = vocab.select(_join_key(F.col("term")).alias("key"), F.col("token_id").cast("int").alias("token_id"))
    frequent = keys.where(F.col("token_id") < reserved + head).collect()
    known = df.sparkSession.sparkContext.broadcast({r.key: r.token_id for r in frequent})

    @F.pandas_udf("ids array<int>, missing array<string>")
    def look_up(rows: pd.Series) -> pd.DataFrame:
        ids, missing = [], []
        for terms in rows:
            row = [known.value.get(_key_of(t), -1) for t in terms] if terms is not None else []
            ids.append(row)
            missing.append(list({_key_of(t) for t, i in zip(terms, row, strict=True) if i < 0}) if row else [])
        return pd.DataFrame({"ids": ids, "missing": missing})

    own = (id_col, *keep)
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *own, tokens.alias("__terms"))
    rows = checkpointed(rows.withColumn("__found", look_up("__terms")))
    asked = rows.select("__row", F.explode("__found.missing").alias("key"))
    others = keys.where(F.col("token_id") >= reserved + head)
    answers = asked.join(others, "key").groupBy("__row")
    answers = answers.agg(F.collect_list(F.struct("key", "token_id")).alias("__rare"))

    @F.pandas_udf("array<int>")
    def fill(ids: pd.Series, terms: pd.Series, rare: pd.Series) -> pd.Series:
        filled = []
        for row, words, answer in zip(ids, terms, rare, strict=True):
            found = {a["key"]: a["token_id"] for a in answer} if answer is not None else {}
            filled.append(
                [int(i) if i >= 0 else found.get(_key_of(t), unknown) for i, t in zip(row, words if words is not None else (), strict=True)]
            )
        return pd.Series(filled, dtype=object)

    whole = rows.join(answers, "__row", "left")
    return whole.select(*own, fill("__found.ids", "__terms", "__rare").alias(out))


def collate(
    df: DataFrame, id_col: str, batch_size: int, pad_id: int = PAD_ID, seed: int = 42
) -> DataFrame:
    """``id, batch_no, input_ids, attention_mask, labels`` padded to the batch's longest member.

    Batches are consecutive rows of the seeded shuffle order. Labels repeat the input ids; what is
    ignored is the padding by its position, whatever ids the row holds. Lengths alone are ranked
    and grouped, so the arrays shuffle once, to meet their batch. Rows may repeat ids.
    """
    df = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    lengths = df.select(id_col, "__row", F.size("input_ids").alias("length"))
    placed = with_position(lengths, id_col, seed, "__row").withColumn(
        "batch_no", F.floor(F.col("position") / batch_size)
    )
    longest = placed.withColumn(
        "longest", F.max("length").over(Window.partitionBy("batch_no"))
    ).select("__row", "batch_no", "longest")
    ids = pad_ids(F.col("input_ids"), F.col("longest"), pad_id)
    mask = pad_ids(F.col("attention_mask").cast("array<int>"), F.col("longest"), 0)
    labels = pad_ids(F.col("input_ids"), F.col("longest"), IGNORE_LABEL)
    return df.join(longest, "__row").select(
        id_col,
        "batch_no",
        ids.alias("input_ids"),
        mask.cast("array<tinyint>").alias("attention_mask"),
        labels.cast("array<bigint>").alias("labels"),
    )


def find_bad_tokens(df: DataFrame, vocab_size: int | Column, strict: bool = False) -> DataFrame:
    """Rows holding ids or labels outside the vocabulary, with the offenders."""
    flagged = df.withColumns(
        {
            "bad_inputs": bad_input_ids(F.col("input_ids"), vocab_size),
            "bad_labels": bad_labels(F.col("labels"), vocab_size, strict),
        }
    )
    return flagged.where((F.size("bad_inputs") > 0) | (F.size("bad_labels") > 0))


def token_report(
    df: DataFrame,
    vocab_size: int | Column,
    id_col: str = "id",
    split: str = "split",
    strict: bool = False,
    shown: int = 10,
) -> DataFrame:
    """Per split: rows, bad rows, the first bad ids in order and whether it passes.

    All rows are checked. The ids shown are a bounded list per split, found by rank.
    """
    bad = (F.size(bad_input_ids(F.col("input_ids"), vocab_size)) > 0) | (
        F.size(bad_labels(F.col("labels"), vocab_size, strict)) > 0
    )
    checked = df.select(split, F.col(id_col).alias("id"), bad.alias("bad"))
    counts = checked.groupBy(split).agg(
        F.count("*").alias("rows"), F.count_if("bad").cast("bigint").alias("issues")
    )
    # row_number() <= n is pushed into each task before the shuffle (WindowGroupLimit).
    ranked = checked.where("bad").withColumn(
        "rn", F.row_number().over(Window.partitionBy(split).orderBy("id"))
    )
    first = (
        ranked.where(F.col("rn") <= shown)
        .groupBy(split)
        .agg(F.array_sort(F.collect_list("id")).alias("first_bad"))
    )
    return counts.join(first, split, "left").withColumn("passed", F.col("issues") == 0)


def issue_sample(
    df: DataFrame, vocab_size: int | Column, id_col: str = "id", rows: int = 3, ids: int = 5
) -> DataFrame:
    """The first few bad rows with their first few offending ids."""
    bad = find_bad_tokens(df, vocab_size).select(
        F.col(id_col).alias("id"),
        F.slice("bad_inputs", 1, ids).alias("bad_inputs"),
        F.slice("bad_labels", 1, ids).alias("bad_labels"),
    )
    return bad.orderBy("id").limit(rows)
