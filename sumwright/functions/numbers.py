"""Number parsing and rounding used by the program executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.text import bind, strip

# A decimal literal. ``try_cast`` alone would also take '1d', '0x1p3' and 'nan'.
NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"

CONST_PREFIX = "const_"


def parse_float(text: Column) -> Column:
    """Text → double; null unless the whole text is one decimal literal."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def str_to_num(text: Column) -> Column:
    """Program argument or table cell → double, null when it is not a number.

    Thousands separators are dropped; ``12%`` is 0.12; ``const_7`` is 7 and ``const_m1`` is -1.
    """

    def general(plain: Column) -> Column:
        percent = F.replace(plain, F.lit("%"), F.lit(""))
        const = F.replace(plain, F.lit(CONST_PREFIX), F.lit(""))
        return (
            F.when(plain.rlike(NUMBER), plain.try_cast("double"))
            .when(plain.contains("%"), bind(strip(percent), parse_float) / F.lit(100.0))
            .when(
                plain.contains("const"),
                F.when(strip(const) == "m1", F.lit(-1.0)).otherwise(parse_float(const)),
            )
        )

    # Most arguments are plain literals: settle those before anything is copied.
    return F.when(text.rlike(NUMBER), text.try_cast("double")).otherwise(
        bind(F.replace(text, F.lit(","), F.lit("")), general)
    )


def const_value(token: Column) -> Column:
    """``const_N`` → N, anything else null (``const_m1`` too: the screening rule)."""
    return F.when(
        token.startswith(CONST_PREFIX),
        parse_float(F.substring(token, len(CONST_PREFIX) + 1, 2147483647)),
    )


def row_to_nums(cells: Column) -> Column:
    """Table cells → array of doubles; null for the whole row when any cell is no number.

    A currency sign is dropped and only the text before the first parenthesis counts.
    """

    def cell(text: Column) -> Column:
        return bind(
            F.replace(text, F.lit("$"), F.lit("")),
            lambda bare: F.when(bare.rlike(NUMBER), bare.try_cast("double")).otherwise(
                str_to_num(strip(F.substring_index(bare, "(", 1)))
            ),
        )

    nums = F.transform(cells, cell)
    return bind(nums, lambda xs: F.when(~F.exists(xs, F.isnull), xs))


def round_exact(value: Column, digits: int = 5) -> Column:
    """Round the exact binary value to ``digits`` decimals, ties to even, like Python's ``round``.

    SQL ``round`` works on the shortest decimal text instead, so 2.675 gives 2.68 there and 2.67
    here. The product with 10^digits is split into a rounded part and its exact error; the error
    settles what the rounded part cannot. From 2^51 / 10^digits on the whole part is set aside
    first and joined again in decimal arithmetic; from 2^53 on every number is whole.
    """
    scale = float(10**digits)
    # 27-bit split (2^27 + 1): ``high * scale`` and ``low * scale`` are exact for scale < 2^26.
    splitter = 134217729.0
    # Above this the product has no spare fraction bits; below it everything is exact.
    exact_below, whole_from = 2.0**51 / scale, 2.0**53

    def counted(x: Column) -> Column:
        """``x`` in units of the last decimal, rounded."""
        product = x * scale
        high = x * splitter - (x * splitter - x)
        error = (high * scale - product) + (x - high) * scale

        def settle(parts: Column) -> Column:
            base, above_half = parts["base"], parts["frac"] - 0.5
            odd = F.pmod(base, F.lit(2.0)) == 1.0
            up = (above_half > 0) | (
                (above_half == 0) & ((parts["error"] > 0) | ((parts["error"] == 0) & odd))
            )
            return base + F.when(up, 1.0).otherwise(0.0)

        floor = F.floor(product).cast("double")
        return bind(
            F.struct(
                floor.alias("base"), (product - floor).alias("frac"), error.alias("error")
            ),
            settle,
        )

    def apart(x: Column) -> Column:
        size = F.abs(x)
        whole = F.floor(size)
        units = counted(size - whole.cast("double")).cast("bigint").cast("decimal(10,0)")
        joined = whole.cast("decimal(20,0)") + units * F.lit(1).cast("decimal(1,0)") / F.lit(10**digits)
        return F.signum(x) * joined.cast("double")

    def rounded(x: Column) -> Column:
        return (
            F.when(F.abs(x) < exact_below, counted(x) / scale)
            .when(F.abs(x) < whole_from, apart(x))
            .otherwise(x)
        )

    return bind(value, rounded)
