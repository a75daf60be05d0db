"""Algebraic equality of two programs by polynomial identity testing.

Each distinct literal of the gold program is a symbol. A program is a rational expression over the
symbols; two expressions are equal when they agree at random points of a prime field, which a
wrong pair passes with probability of about degree / 2^31 per point (Schwartz and Zippel).

Comparisons are opaque: a node becomes a new symbol named by its operands' values. A power is an
element of the field's subgroup of prime order: the generator to the product of a number named by the
base and the exponent, which is evaluated over the integers modulo that order, itself a field. So
powers of equal bases multiply by adding exponents, whatever rational expressions these are, and laws
that hold for positive bases alone do not come in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.program_text import (
    TABLE_PREFIX,
    raw_token_steps,
    same_tokens,
    structure_ok,
)
from sumwright.functions.text import bind, strip

#: A prime below 2^31 of which half the predecessor is a prime as well, and a square, which generates
#: the subgroup of that order.
PRIME = 2147483579
ORDER = (PRIME - 1) // 2
GENERATOR = 4
SEEDS = (1009, 2003, 3001)

#: A quotient over the field, the same over the integers modulo ORDER, and whether it is a comparison.
NODE_TYPE = "struct<n:bigint,d:bigint,m:bigint,e:bigint,truth:boolean>"

_REFERENCE = r"\A\s*[+-]?\d+\s*\z"


def _mod(value: Column, modulus: int = PRIME) -> Column:
    return F.pmod(value, F.lit(modulus).cast("bigint"))


def _mul(x: Column, y: Column, modulus: int = PRIME) -> Column:
    return _mod(x * y, modulus)


def _inverse(x: Column, modulus: int = PRIME) -> Column:
    # The exponent of the modular inverse, highest bit first.
    bits = F.lit([int(bit) for bit in format(modulus - 2, "b")])
    inverse = F.aggregate(
        bits,
        F.lit(1).cast("bigint"),
        lambda r, bit: F.when(bit == 1, _mul(_mul(r, r, modulus), x, modulus)).otherwise(_mul(r, r, modulus)),
    )
    # Most values are no quotients.
    return F.when(x == 1, x).otherwise(inverse)


def _generated(exponent: Column) -> Column:
    """The generator to a power below ORDER: the product of the powers that its hexadecimal digits choose."""
    made = None
    for low in range(0, ORDER.bit_length(), 4):
        powers = [F.lit(pow(GENERATOR, digit << low, PRIME)).cast("bigint") for digit in range(16)]
        digit = F.shiftright(exponent, low).bitwiseAND(F.lit(15).cast("bigint")).cast("int")
        chosen = F.get(F.array(*powers), digit)
        made = chosen if made is None else _mul(made, chosen)
    return made


def _symbol(*parts: Column, modulus: int = PRIME) -> Column:
    return _mod(F.xxhash64(*parts), modulus)


def _steps(tokens: Column, positional_tables: bool) -> Column:
    """Steps with their symbol names and references; a null op marks a malformed step."""

    def ref(arg: Column) -> Column:
        bare = F.replace(arg, F.lit("#"), F.lit(""))
        # -1 is out of range, so a reference that is no number is never admissible.
        number = F.when(bare.rlike(_REFERENCE), strip(bare).try_cast("int"))
        return F.when(arg.contains("#"), F.coalesce(number, F.lit(-1)))

    def literal(arg: Column) -> Column:
        return F.when(~arg.contains("#"), F.concat(F.lit("lit|"), arg))

    def fields(op: Column, is_table: bool, a: Column, b: Column, refs: tuple) -> Column:
        nothing = F.lit(None)
        a_ref, b_ref = refs or (nothing, nothing)
        return F.struct(
            op.alias("op"),
            F.lit(is_table).alias("is_table"),
            a.cast("string").alias("a"),
            b.cast("string").alias("b"),
            a_ref.cast("int").alias("a_ref"),
            b_ref.cast("int").alias("b_ref"),
        )

    def step(s: Column, i: Column) -> Column:
        def named(v: Column) -> Column:
            op, a, b = v["op"], v["a"], v["b"]
            clean = (a != "") & (b != "") & ~F.concat(a, b).rlike(r"[()|]")
            good_op = F.when((s["op"] == F.concat(op, F.lit("("))) & clean, op)
            place = (i == 0).cast("string") if positional_tables else F.lit("")
            row = F.concat_ws("|", F.lit("row"), op, a, b, place)
            return F.when(
                op.startswith(TABLE_PREFIX), fields(good_op, True, row, F.lit(None), ())
            ).otherwise(fields(good_op, False, literal(a), literal(b), (ref(a), ref(b))))

        parts = F.struct(
            F.btrim(s["op"], F.lit("(")).alias("op"),
            strip(s["a"]).alias("a"),
            strip(s["b"]).alias("b"),
        )
        return bind(parts, named)

    return F.transform(raw_token_steps(tokens), step)


def _well_formed(steps: Column) -> Column:
    """Every step complete and every reference backwards."""

    def fine(s: Column, i: Column) -> Column:
        a_ok = s["a"].isNotNull() | ((s["a_ref"] >= 0) & (s["a_ref"] < i))
        b_ok = s["is_table"] | s["b"].isNotNull() | ((s["b_ref"] >= 0) & (s["b_ref"] < i))
        return F.coalesce(s["op"].isNotNull() & a_ok & b_ok, F.lit(False))

    return (F.size(steps) > 0) & F.forall(F.transform(steps, fine), lambda ok: ok)


def _names(steps: Column) -> Column:
    return F.array_distinct(
        F.array_compact(F.flatten(F.transform(steps, lambda s: F.array(s["a"], s["b"]))))
    )


def _value_at(steps: Column, seed: Column, powers: bool) -> Column:
    """The last step's value at the random point given by ``seed``.

    Only with ``powers`` are values carried over the integers modulo ORDER, too.
    """
    one = F.lit(1).cast("bigint")

    def node(n: Column, d: Column, m: Column = one, e: Column = one, truth: bool = False) -> Column:
        parts = (n.alias("n"), d.alias("d"), m.alias("m"), e.alias("e"), F.lit(truth).alias("truth"))
        return F.struct(*parts).cast(NODE_TYPE)

    def exponent_symbol(*parts: Column) -> Column:
        return _symbol(F.lit("exponent"), *parts, seed, modulus=ORDER) if powers else one

    def named(name: Column) -> Column:
        return node(_symbol(name, seed), one, exponent_symbol(name))

    def operand(name: Column, ref: Column, acc: Column) -> Column:
        return F.when(name.isNotNull(), named(name)).otherwise(F.get(acc, ref))

    def power(v: Column) -> Column:
        """``x`` to the ``y``, whose value modulo ORDER is ``z``."""
        of = _mul(_symbol(F.lit("base"), v["x"], seed, modulus=ORDER), v["z"], ORDER)
        made = bind(of, _generated)
        return bind(made, lambda value: node(value, one, exponent_symbol(value)))

    def opaque(op: Column, v: Column) -> Column:
        x, y = v["x"], v["y"]
        trivial = F.when((y == 0) | (x == 1), node(one, one)).when(y == 1, node(x, one, v["w"]))
        # A value is never greater than itself, whatever it is.
        order = F.when(x == y, node(one - 1, one, truth=True)).otherwise(
            node(_symbol(F.lit("greater"), x, y, seed), one, truth=True)
        )
        return F.when(op == "exp", trivial.otherwise(power(v)) if powers else trivial).otherwise(order)

    def apply(op: Column, v: Column) -> Column:
        x, y = v["x"], v["y"]

        def over(n: str, d: str, modulus: int) -> dict[str, Column]:
            left, right = _mul(x[n], y[d], modulus), _mul(y[n], x[d], modulus)
            below = _mul(x[d], y[d], modulus)
            return {
                "add": (_mod(left + right, modulus), below),
                "subtract": (_mod(left - right, modulus), below),
                "multiply": (_mul(x[n], y[n], modulus), below),
                "divide": (left, _mul(x[d], y[n], modulus)),
            }

        field = over("n", "d", PRIME)
        exponents = over("m", "e", ORDER) if powers else {}
        made = F.when(x["truth"] | y["truth"], F.lit(None).cast(NODE_TYPE))
        for name, value in field.items():
            made = made.when(op == name, node(*value, *exponents.get(name, ())))
        reduced = [_mul(v["n"], _inverse(v["d"])) for v in (x, y)]
        lower = [_mul(v["m"], _inverse(v["e"], ORDER), ORDER) if powers else one for v in (x, y)]
        names = ("x", "y", "w", "z")
        values = F.struct(*[c.alias(name) for c, name in zip((*reduced, *lower), names, strict=True)])
        made = made.when(_mul(x["d"], y["d"]) == 0, node(one, one - 1))
        return made.when(op.isin("exp", "greater"), bind(values, lambda v: opaque(op, v)))

    def run(acc: Column, s: Column) -> Column:
        value = F.when(s["is_table"], named(s["a"])).otherwise(
            bind(
                F.struct(
                    operand(s["a"], s["a_ref"], acc).alias("x"),
                    operand(s["b"], s["b_ref"], acc).alias("y"),
                ),
                lambda v: apply(s["op"], v),
            )
        )
        return F.concat(acc, F.array(value))

    values = F.aggregate(steps, F.array().cast(f"array<{NODE_TYPE}>"), run)
    return F.element_at(values, -1)


def equal_program(gold: Column, pred: Column, positional_tables: bool = False) -> Column:
    """Whether two token programs are the same expression over the gold program's literals.

    The prediction may use only literals and table steps of the gold program and may refer only to
    earlier steps; the value of its last step is what counts. Literals are compared as text, so
    ``100`` and ``100.0`` differ. ``positional_tables`` also tells a table step in first place from
    the same step later on. Never null.
    """

    def compare(both: Column) -> Column:
        gold_steps, pred_steps = both["gold"], both["pred"]
        admissible = (
            _well_formed(gold_steps)
            & _well_formed(pred_steps)
            & (F.size(F.array_except(_names(pred_steps), _names(gold_steps))) == 0)
        )
        identical = same_tokens(gold, pred)
        # A comparison feeding arithmetic has no value, so it is not equal even to itself.
        compares = F.array_contains(pred, "greater(")

        def agree(seed: Column, powers: bool) -> Column:
            return bind(
                F.struct(
                    _value_at(gold_steps, seed, powers).alias("g"),
                    _value_at(pred_steps, seed, powers).alias("p"),
                ),
                lambda v: F.coalesce(
                    (v["g"]["truth"] == v["p"]["truth"])
                    & (_mul(v["g"]["n"], v["p"]["d"]) == _mul(v["p"]["n"], v["g"]["d"]))
                    & ((v["g"]["d"] != 0) & (v["p"]["d"] != 0) | identical),
                    F.lit(False),
                ),
            )

        seeds = F.array(*[F.lit(seed) for seed in SEEDS])
        return (
            F.when(~admissible, False)
            .when(identical & ~compares, True)
            .when(F.array_contains(pred, "exp(") | F.array_contains(gold, "exp("), F.forall(seeds, lambda s: agree(s, True)))
            .otherwise(F.forall(seeds, lambda s: agree(s, False)))
        )

    steps = F.struct(
        _steps(gold, positional_tables).alias("gold"),
        _steps(pred, positional_tables).alias("pred"),
    )
    return F.coalesce(
        F.when(~structure_ok(pred), False).otherwise(bind(steps, compare)), F.lit(False)
    )
