"""Token counts with a cache by content digest.

Texts are known by the digest of their content, counts by that digest and the digest of tokenizer
file and library. Only distinct texts that the cache does not hold are encoded; their counts are
appended to it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.llm.shared import col, materialize, new_path

LIMIT = 512
CACHE = "digest binary, version string, n_tokens long"
#: Characters encoded at a time, and words whose counts a task remembers.
CHUNK = 2**21
MEMORY = 2**20


def tokenizer_path(name: str) -> str:
    """A file's place on this machine: a path as it is, else one of the installed vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def version(name: str) -> str:
    """Digest of the tokenizer's file, library and the library's version."""
    if name.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(tokenizer_path(name), "rb") as file:
        content = hashlib.sha256(file.read())
    content.update(f"{library.__name__} {library.__version__}".encode())
    return content.hexdigest()


class Encoder:
    """Numbers of tokens as the tokenizer's library gives them, without added special tokens."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        self.words: dict[str, int] = {}
        self.by_words, self.specials = False, ()
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.library = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as file:
                shape = json.load(file)
            split = shape.get("pre_tokenizer") or {}
            self.by_words = (
                shape["model"].get("type", "BPE") == "BPE"
                and not shape.get("normalizer")
                and split.get("type") == "ByteLevel"
                and split.get("use_regex", True)
                and not split.get("add_prefix_space")
            )
            self.specials = tuple(t["content"] for t in shape.get("added_tokens", ()))
        elif name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"{name} is neither a .json nor a .model file")

    def simple(self, text: str) -> bool:
        """Whether words stand alone: one blank or line end between two, no special string.

        A byte-level tokenizer splits a text before such a blank and around such a line end,
        whatever stands beside them, and never merges across; counts of the parts then add up.
        """
        return " ".join(text.split()) == text.replace("\n", " ") and not any(s in text for s in self.specials)

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_words:
            return self.library(texts)
        lines: list[list[list[str]] | None] = []
        unseen: set[str] = set()
        if len(self.words) > MEMORY:
            self.words.clear()
        for text in texts:
            if not text or not self.simple(text):
                lines.append(None)
                continue
            # Words after a blank are kept without it; a line's first word is marked by a line end.
            parts = [line.split(" ") for line in text.split("\n")]
            for words in parts:
                words[0] = "\n" + words[0]
                unseen.update(words)
            lines.append(parts)
        unseen -= self.words.keys()
        new = list(unseen)
        spelled = [w[1:] if w[0] == "\n" else " " + w for w in new]
        self.words.update(zip(new, self.library(spelled), strict=True))
        whole = iter(self.library([t for t, parts in zip(texts, lines, strict=True) if parts is None]))
        line_end = self.library(["\n"])[0]
        known = self.words.__getitem__
        return [
            next(whole) if parts is None else sum(sum(map(known, words)) for words in parts) + line_end * (len(parts) - 1)
            for parts in lines
        ]


def encode(misses: DataFrame, name: str, of: str) -> DataFrame:
    """``digest, version, n_tokens`` of rows ``digest, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        encoder = Encoder(name)
        for batch in batches:
            counts, texts, size = [], [], 0
            for text in batch.column("content").to_pylist():
                texts.append(text)
                size += len(text)
                if size > CHUNK:
                    counts += encoder.count(texts)
                    texts, size = [], 0
            counts += encoder.count(texts)
            versions = pa.array([of] * len(counts), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), versions, pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"]
            )

    return misses.select("digest", "content").mapInArrow(run, CACHE)


def cached(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """``key, n_tokens`` of one tokenizer version, each digest once; creates the cache if missing."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == of)
    # Two runs at once may both have appended a digest.
    return materialize(stored.groupBy(F.col("digest").alias("key")).agg(F.max("n_tokens").alias("n_tokens")), "token-cache")


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    cache: str | None = None,
    limit: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``tokenizer`` is a file that every machine has, by path or installed name. ``cache`` is a
    folder that all share, kept for later runs; without it a new one is used. Null texts count as
    empty, 0 bytes and 0 tokens; repeated rows give repeated rows, and their text is encoded once.
    """
    spark, of = docs.sparkSession, version(tokenizer)
    cache = cache or new_path(spark, "token-counts")
    content = F.coalesce(col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    known = cached(spark, cache, of)
    texts = docs.select(digest.alias("digest"), content.alias("content"))
    missing = texts.join(known, F.col("digest") == F.col("key"), "left_anti")
    misses = missing.groupBy("digest").agg(F.first("content").alias("content"))
    encode(misses, tokenizer, of).write.mode("append").parquet(cache)
    known = cached(spark, cache, of)
    rows = docs.select(col(doc_id).alias("doc_id"), digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    counted = rows.join(known, F.col("digest") == F.col("key"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
