"""The four jobs end to end: prepare, decode, evaluate and build a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwright.functions.cleaning import clean_text
from sumwright.functions.packing import pack, target_text, truncate
from sumwright.functions.program_text import dropped_steps
from sumwright.functions.prompts import chat_wrap, render_table_json, user_prompt
from sumwright.functions.quality import clarity, rouge_l, terms
from sumwright.functions.similarity import term_cosine
from sumwright.functions.text import words
from sumwright.operators.corpus import chunk_records, chunk_recursive
from sumwright.operators.decode import decode, format_stats, select_candidate
from sumwright.operators.evaluate import accuracy, error_rows, score
from sumwright.operators.tokens import build_vocab, encode
from sumwright.session import checkpointed
from sumwright.sources.examples import linear_program, program_text, typed_examples


def prompts(
    raw_examples: DataFrame, wording: str = "train", prefix: str = "", suffix: str = ""
) -> DataFrame:
    """``id, prompt_text, program_text, dropped_steps`` of raw examples. A map; nothing shuffles."""
    typed = typed_examples(raw_examples)
    prompt = user_prompt(
        F.col("pre"),
        F.col("post"),
        render_table_json(F.col("table_json"), F.col("table_kind")),
        F.col("question"),
        wording,
    )
    return typed.select(
        "id",
        chat_wrap(prompt, prefix, suffix).alias("prompt_text"),
        linear_program(F.col("program"), F.col("program_kind")).alias("program_text"),
        dropped_steps(program_text(F.col("program"), F.col("program_kind"))).alias("dropped_steps"),
    )


def prepare(prompted: DataFrame, vocab: DataFrame | None = None, max_len: int | None = None) -> DataFrame:
    """``id, input_ids, attention_mask, labels`` from ``id, prompt_text, program_text``.

    Every row stays one row, whatever its id. Without a vocabulary one is built from the same texts
    and written down once. Ids 0 and 1 are kept for padding and for words outside the vocabulary.
    """
    texts = prompted.select(
        "id",
        words(F.col("prompt_text")).alias("prompt"),
        words(target_text(F.col("program_text"))).alias("target"),
    )
    if vocab is None:
        counted = texts.select(F.explode(F.concat("prompt", "target")).alias("term"))
        counts = counted.groupBy("term").agg(F.count("*").alias("n"))
        vocab = checkpointed(build_vocab(checkpointed(counts)))
    sized = texts.select("id", F.concat("prompt", "target").alias("all"), F.size("prompt").alias("p"))
    ids = checkpointed(encode(sized, "id", F.col("all"), vocab, keep=("p",)))
    prompt = F.slice("ids", F.lit(1), F.col("p"))
    target = F.slice("ids", F.col("p") + 1, F.size("ids") - F.col("p"))
    packed = pack(prompt if max_len is None else truncate(prompt, max_len), target)
    return ids.select("id", packed.alias("packed")).select("id", "packed.*")


def predict(raw_texts: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and their format report from ``id, raw_text`` plus the sampling ``order``.

    Without an order there is one text per id and decoding is a map.
    """
    decoded = decode(raw_texts)
    chosen = select_candidate(decoded, "id", *order) if order else decoded.select("id", "predicted")
    return chosen, format_stats(chosen)


def evaluate(
    predictions: DataFrame, gold: DataFrame, tolerance: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accuracy report and error rows."""
    scored = score(predictions, gold, tolerance)
    return accuracy(scored), error_rows(scored)


def build_collection(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Cleaned and chunked documents as collection records."""
    cleaned = docs.select(doc, clean_text(F.col(text)).alias("text"))
    return chunk_records(chunk_recursive(cleaned, doc), doc)


def pair_scores(pairs: DataFrame) -> DataFrame:
    """``faithfulness, clarity, rouge_l`` of ``question, answer, context`` rows, over whole texts."""
    context, answer = F.col("context"), F.col("answer")
    return pairs.withColumns(
        {
            "faithfulness": term_cosine(terms(answer), terms(context)),
            "clarity": clarity(F.col("question"), answer),
            "rouge_l": rouge_l(answer, context),
        }
    )


def pair_report(scored: DataFrame) -> DataFrame:
    """One-row means of the pair scores."""
    return scored.agg(
        F.count("*").alias("pairs"),
        *[F.avg(c).alias(c) for c in ("faithfulness", "clarity", "rouge_l")],
    )
