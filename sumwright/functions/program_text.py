"""Programs as text, as flat tokens and as steps.

Text:   ``subtract(5, 3), divide(#0, 3)`` (gold) or ``subtract(5, 3) divide(#0, 3)`` (linearized)
Tokens: ``['subtract(', '5', '3', ')', 'divide(', '#0', '3', ')', 'EOF']``
Steps:  ``[{op: 'subtract', a: '5', b: '3'}, {op: 'divide', a: '#0', b: '3'}]``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.text import bind, squeeze, strip

# Operation names and markers of the program language.
ARITHMETIC_OPS = ["add", "subtract", "multiply", "divide", "exp", "greater"]
TABLE_OPS = ["table_max", "table_min", "table_sum", "table_average"]
ALL_OPS = ARITHMETIC_OPS + TABLE_OPS
TABLE_PREFIX = "table_"
EOF = "EOF"
ANSWER_MARK = "Program:"
STOP_MARKS = ["\n\nQuestion:", "\n\nContext:", "\n\nAnswer:", "\n\nFinal", "Explanation:"]

STEP_TYPE = "array<struct<op:string,a:string,b:string>>"

# How a call is written.
_KNOWN_CALL = (
    r"(?i)(?:" + "|".join(ARITHMETIC_OPS) + r"|table_[a-z_]+)"
    r"\s*\(\s*[^,)]+\s*,\s*[^,)]+\s*\)"
)
_OPENING = r"(?i)(?:" + "|".join(ARITHMETIC_OPS) + r"|table_[a-z_]+)\s*\("
_ANY_CALL = r"[a-zA-Z_][a-zA-Z0-9_]*\s*\(\s*[^,)]+\s*,\s*[^,)]+\s*\)"
# Any call; group 1 is empty unless the decoder takes its operation (``is_valid_op``).
_LISTED_CALL = (
    r"((?i:" + "|".join(ARITHMETIC_OPS) + r"|table_[a-z0-9_]*)"
    r"\s*\(\s*[^,)]+\s*,\s*[^,)]+\s*\))|" + _ANY_CALL
)
# One call of a squeezed text: operation and stripped arguments.
_CALL_PARTS = r"([^( ]+) ?\( ?([^,]*?) ?, ?([^)]*?) ?\)"


def _empty_steps() -> Column:
    return F.array().cast(STEP_TYPE)


def _call_to_step(call: Column) -> Column:
    """``op ( a , b )`` → step. The first parenthesis ends the op, the only comma ends ``a``."""
    inner = F.substring_index(call, ")", 1)
    args = F.substring(inner, F.instr(inner, "(") + 1, F.lit(2147483647))
    return F.struct(
        strip(F.substring_index(inner, "(", 1)).alias("op"),
        strip(F.substring_index(args, ",", 1)).alias("a"),
        strip(F.substring_index(args, ",", -1)).alias("b"),
    )


def is_valid_op(op: Column) -> Column:
    """Decoder whitelist, any case: the arithmetic operations and every ``table_`` name."""
    low = F.lower(op)
    return low.isin(ARITHMETIC_OPS) | low.startswith(TABLE_PREFIX)


def linearize_program(program: Column) -> Column:
    """Program text → ``op(a, b) op(a, b)``; a null program gives ``''``.

    Everything that is not a known two-argument call is dropped, so a call with a comma inside an
    argument disappears.
    """
    calls = F.regexp_extract_all(squeeze(program), F.lit(_KNOWN_CALL), F.lit(0))
    return F.coalesce(F.array_join(F.transform(calls, _render_call), " "), F.lit(""))


def _render_call(call: Column) -> Column:
    return bind(
        _call_to_step(call),
        lambda s: F.concat(F.lower(s["op"]), F.lit("("), s["a"], F.lit(", "), s["b"], F.lit(")")),
    )


def dropped_steps(program: Column) -> Column:
    """How many openings of a known operation ``linearize_program`` finds no call for; 0 for null.

    ``divide(1,000, 50)`` is one: a comma inside a number leaves no two arguments.
    """
    flat = squeeze(program)
    openings = F.regexp_count(flat, F.lit(_OPENING)) - F.regexp_count(flat, F.lit(_KNOWN_CALL))
    return F.coalesce(openings, F.lit(0))


def linearize_tokens(tokens: Column) -> Column:
    """Same for a program given as a token list."""
    calls = F.regexp_extract_all(F.array_join(tokens, " "), F.lit(_KNOWN_CALL), F.lit(0))
    return F.coalesce(F.array_join(F.transform(calls, _render_call), " "), F.lit(""))


def tokenize_program(program: Column) -> Column:
    """Gold text → tokens: split at ``", "``, after ``(`` and around ``)``; ``EOF`` appended."""
    cut = "\x01"
    marked = F.replace(program, F.lit(", "), F.lit(cut))
    pattern = rf"[^(){cut}]*\(|\)|[^(){cut}]+"
    return F.array_append(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)), F.lit(EOF))


def parse_raw_to_steps(raw: Column) -> Column:
    """Generated text → steps. Text before the answer mark and after a stop mark is ignored."""
    calls = F.regexp_extract_all(_answer(raw), F.lit(_ANY_CALL), F.lit(0))
    steps = F.filter(F.transform(calls, _call_to_step), lambda s: is_valid_op(s["op"]))
    return F.coalesce(steps, _empty_steps())


def parse_raw_to_tokens(raw: Column) -> Column:
    """``steps_to_tokens(parse_raw_to_steps(raw))`` without a fold, as text that Spark compiles.

    No part of a call holds a comma, so tokens are joined by commas and split again.
    """
    calls = F.regexp_extract_all(_answer(raw), F.lit(_LISTED_CALL), F.lit(1))
    listed = F.regexp_replace(F.array_join(calls, ""), _CALL_PARTS, "$1(,$2,$3,),")
    return F.split(F.concat(F.coalesce(listed, F.lit("")), F.lit(EOF)), ",")


def _answer(raw: Column) -> Column:
    """Generated text between the answer mark and the first stop mark, whitespace squeezed."""
    at = F.instr(raw, ANSWER_MARK)
    skip = F.when(at > 0, at + len(ANSWER_MARK)).otherwise(1)
    body = F.substring(raw, skip, F.lit(2147483647))
    for mark in STOP_MARKS:
        body = F.substring_index(body, mark, 1)
    return squeeze(body)


def steps_to_tokens(steps: Column) -> Column:
    """Steps → four tokens each, then ``EOF``; no steps gives ``['EOF']``."""
    four = F.transform(
        steps, lambda s: F.array(F.concat(s["op"], F.lit("(")), s["a"], s["b"], F.lit(")"))
    )
    return F.array_append(F.coalesce(F.flatten(four), F.array().cast("array<string>")), F.lit(EOF))


def token_body(tokens: Column) -> Column:
    """Every token but the last, whatever the last is."""
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def _group_body(tokens: Column) -> Column:
    """Complete groups of four body tokens as raw steps (``op`` keeps its parenthesis).

    Tokens are bound: what is not a variable would be computed anew in every step.
    """

    def grouped(tokens: Column) -> Column:
        count = F.floor((F.size(tokens) - 1) / 4).cast("int")
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.struct(
                    F.get(tokens, i * 4).alias("op"),
                    F.get(tokens, i * 4 + 1).alias("a"),
                    F.get(tokens, i * 4 + 2).alias("b"),
                ),
            ),
        ).otherwise(_empty_steps())

    return bind(tokens, grouped)


def raw_token_steps(tokens: Column) -> Column:
    """Tokens → steps whose ``op`` still holds its parenthesis; an incomplete tail is dropped."""
    return _group_body(tokens)


def tokens_to_steps(tokens: Column) -> Column:
    """Verified tokens → steps with lowercase op."""
    return F.transform(
        _group_body(tokens),
        lambda s: F.struct(
            F.lower(F.left(s["op"], F.length(s["op"]) - 1)).alias("op"),
            s["a"].alias("a"),
            s["b"].alias("b"),
        ),
    )


def verify_tokens(tokens: Column) -> Column:
    """Four-token pattern with a final ``EOF``; a lone ``EOF`` is fine. Never null."""
    size = F.size(tokens)
    body = token_body(tokens)

    def broken(token: Column, i: Column) -> Column:
        place = i % 4
        op_bad = ~(
            token.endswith("(") & is_valid_op(F.left(token, F.length(token) - 1))
        )
        return ((place == 0) & op_bad) | ((place == 3) & (token != ")"))

    shaped = ((size - 1) % 4 == 0) & (F.size(F.filter(body, broken)) == 0)
    return F.coalesce(
        F.when(size < 1, False)
        .when(F.element_at(tokens, -1) != EOF, False)
        .otherwise(shaped),
        F.lit(False),
    )


def structure_ok(tokens: Column) -> Column:
    """Evaluator check: every fourth token an exact op, every step's last token ``)``.

    The token count is not checked; an incomplete last step passes.
    """

    def broken(token: Column, i: Column) -> Column:
        place = i % 4
        return (
            token.isNull()
            | ((place == 0) & ~F.btrim(token, F.lit("(")).isin(ALL_OPS))
            | ((place == 3) & (token != ")"))
        )

    return F.coalesce(F.size(F.filter(token_body(tokens), broken)) == 0, F.lit(False))


def same_tokens(gold: Column, pred: Column) -> Column:
    """Exact match of the concatenated tokens."""
    return F.array_join(gold, "") == F.array_join(pred, "")
