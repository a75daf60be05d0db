"""Prompt text: nested examples, tables and chunks rendered as strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.shapes import LIST, OBJECT, STRING, entries, items, python_text

# Prompt wording. Training and inference differ in the sentence about '#k'.
_INTRO = (
    "You are a program synthesis model for financial question answering.\n"
    "Given the context (before/after text) and a table, write a reasoning Program as a sequence "
    "of operations.\n"
    "Each step must look like: op(arg1, arg2). "
)
TRAIN_RULE = "Use #k to reference the result of step k (starting at #0 after first step).\n\n"
INFER_RULE = (
    "Use #k to reference prior step results (#0 is the first step's result). End with EOF.\n\n"
)
_BEFORE_HEAD = "Context (before table):\n"
_TABLE_HEAD = "\n\nTable:\n"
_AFTER_HEAD = "\n\nContext (after table):\n"
_QUESTION_HEAD = "\n\nQuestion: "
_PROMPT_END = "\n\nProgram:"

QUESTION_PROMPT = """
        You are a financial analyst AI. Read the following text and generate ONE high-quality question that:
        - asks about a specific fact, figure, or policy in the context
        - DO NOT ask for the main idea or a title.
        - Is clear and concise
        - Does NOT ask for a title or trivial detail
        - Can be answered from the context

        Context:
        {chunk}
        """  # noqa: E501
ANSWER_PROMPT = """
        You are a financial analyst AI. Based on the following context, generate a short, clear answer to the question. 
        - If the answer is a fact, provide the fact. 
        - Do not output letters or placeholders. 
        - Answer in a complete sentence using information from the context.
        - Provide a concise answer in one or two sentences. 
        - Do not include headings, page numbers, or unrelated text.

        Context:
        {chunk}

        Question:
        {question}

        Answer:
        """  # noqa: E501


def _fill(template: str, **slots: Column) -> Column:
    """Concatenate a template's literal parts and columns; ``{name}`` marks a column."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def table_or_fallback(table: Column, fallback: Column) -> Column:
    """The example's table, or the one under the alternative name."""
    return F.coalesce(table, fallback)


def join_sentences(sentences: Column) -> Column:
    """Sentence array → text joined by a space; null gives ``''``."""
    return F.coalesce(F.array_join(sentences, " ", "None"), F.lit(""))


def render_table(rows: Column) -> Column:
    """Cell grid → one line per row, cells joined by ``' | '``; null gives ``''``."""
    lines = F.transform(rows, lambda r: F.array_join(r, " | ", "None"))
    return F.coalesce(F.array_join(lines, "\n", "None"), F.lit(""))


def render_table_json(text: Column, kind: Column) -> Column:
    """Same for a table kept as text of a JSON value of that kind.

    A list holds lists, objects (``key: value`` cells) or scalars; an object gives one
    ``key: value`` line per entry; a string stands for itself, other kinds for nothing. Values are
    written as Python's ``str`` does.
    """

    def pairs(of: Column, glue: str) -> Column:
        lines = F.transform(
            entries(of), lambda e: F.concat(e["key"], F.lit(": "), python_text(e["kind"], e["text"]))
        )
        return F.array_join(lines, glue)

    def line(row: Column) -> Column:
        cells = F.transform(items(row["text"]), lambda c: python_text(c["kind"], c["text"]))
        return (
            F.when(row["kind"] == LIST, F.array_join(cells, " | "))
            .when(row["kind"] == OBJECT, pairs(row["text"], " | "))
            .otherwise(python_text(row["kind"], row["text"]))
        )

    rendered = (
        F.when(kind == LIST, F.array_join(F.transform(items(text), line), "\n"))
        .when(kind == OBJECT, pairs(text, "\n"))
        .when(kind == STRING, text)
    )
    return F.coalesce(rendered, F.lit(""))


def user_prompt(
    pre: Column, post: Column, table: Column, question: Column, wording: str = "train"
) -> Column:
    """The program-synthesis prompt; all arguments are rendered text, ``wording`` is ``train`` or
    ``infer``."""
    rule = {"train": TRAIN_RULE, "infer": INFER_RULE}[wording]
    return F.concat(
        F.lit(_INTRO + rule + _BEFORE_HEAD),
        pre,
        F.lit(_TABLE_HEAD),
        table,
        F.lit(_AFTER_HEAD),
        post,
        F.lit(_QUESTION_HEAD),
        question,
        F.lit(_PROMPT_END),
    )


def chat_wrap(prompt: Column, prefix: str, suffix: str) -> Column:
    """One user turn plus the generation prompt of a chat template given by its two halves."""
    return F.concat(F.lit(prefix), prompt, F.lit(suffix))


def qa_template(question: Column, answer: Column) -> Column:
    """Instruction text; a missing value is rendered as ``None``."""
    none = F.lit("None")
    return F.concat(
        F.lit("### Question:\n"),
        F.coalesce(question, none),
        F.lit("\n\n### Answer:\n"),
        F.coalesce(answer.cast("string"), none),
    )


def question_prompt(chunk: Column) -> Column:
    """Prompt asking for one question about a chunk."""
    return _fill(QUESTION_PROMPT, chunk=chunk)


def answer_prompt(chunk: Column, question: Column) -> Column:
    """Prompt asking for the answer to a question about a chunk."""
    return _fill(ANSWER_PROMPT, chunk=chunk, question=question)


def excerpt(text: Column, length: int = 100) -> Column:
    """The first characters of a text, kept as its source reference."""
    return F.substring(text, 1, length)
