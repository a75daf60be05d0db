"""Cleaning of report text as a chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.text import bind, strip

# Patterns and phrases of the cleaning rules.
HEADER_PATTERN = r"sarb.*report"
PUBLISHER = "south african reserve bank"
RIGHTS = "all rights reserved"
SCALED_AMOUNT = r"r\s?([\d.]+) (million|billion|trillion)"
SIMPLE_AMOUNT = r"r([\d,.]+)"
WHOLE_AMOUNT = r"\br(\d[\d,]*(?:\.\d+)?)"
CURRENCY = "ZAR"
SCALES = {"million": 1e6, "billion": 1e9, "trillion": 1e12}

# Java flags: (?U) Unicode classes as in Python, (?d) only '\n' ends a line, (?i) ignore case.
_UNICODE = "(?U)"


def scale_currency(text: Column, unicode_classes: bool = True) -> Column:
    """``r3.4 billion`` → ``3,400,000,000 ZAR``; the product is truncated to an integer.

    Amounts that are no number (``r1.2.3 million``) stay as they are, and those from 1e30 on, of which
    a double does not hold all digits.
    """
    pattern = ("(?iU)" if unicode_classes else "(?i)") + SCALED_AMOUNT

    def amount(match: Column) -> Column:
        number = F.regexp_extract(match, pattern, 1).try_cast("double")
        scale = F.lower(F.regexp_extract(match, pattern, 2))
        factor = F.lit(None).cast("double")
        for name, value in SCALES.items():
            factor = F.when(scale == name, value).otherwise(factor)
        # The whole part of a double, exactly: both halves fit into 64 bits.
        product = number * factor
        high = F.floor(product / 2.0**40)
        low = product - high.cast("double") * 2.0**40
        digits = high.cast("decimal(18,0)") * F.lit(2**40).cast("decimal(13,0)")
        whole = (digits + F.floor(low).cast("decimal(13,0)")).cast("decimal(38,0)")
        amount = F.concat(F.format_number(whole, 0), F.lit(" " + CURRENCY))
        return F.coalesce(F.when(product < 1e30, amount), match)

    gaps = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), amount)
    # One more gap than matches: pair each gap with the amount after it.
    woven = F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(woven, "")).otherwise(text)


def clean_text(
    text: Column,
    unicode_classes: bool = True,
    whole_amounts: bool = False,
    header_pattern: str = HEADER_PATTERN,
    phrases: tuple[str, ...] = (PUBLISHER, RIGHTS),
) -> Column:
    """Lowercase, drop page marks, headers and boilerplate, normalize currency and whitespace.

    The simple currency rule takes every ``r`` before a digit, comma or full stop, so ``year.``
    becomes ``yea. ZAR``; ``whole_amounts`` asks for a word start and a digit instead.
    ``unicode_classes`` turns off Unicode ``\\d`` and ``\\w`` for comparison with ASCII engines.
    """
    u = _UNICODE if unicode_classes else ""
    out = F.lower(text)
    out = F.regexp_replace(out, rf"{u}(?i)page \d+", "")
    out = F.regexp_replace(out, rf"{u}(?i)(?d){header_pattern}", "")
    out = F.translate(out, "©®", "")
    for phrase in phrases:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    out = bind(out, lambda t: scale_currency(t, unicode_classes))
    amount = WHOLE_AMOUNT if whole_amounts else SIMPLE_AMOUNT
    out = F.regexp_replace(out, rf"{u}(?i){amount}", f"$1 {CURRENCY}")
    out = F.regexp_replace(out, r"\n+", "\n")
    out = F.regexp_replace(out, "[ ]+", " ")
    out = F.regexp_replace(out, rf"{u}(\w+)-\n(\w+)", "$1$2")
    return strip(out)


def strip_markup(html: Column) -> Column:
    """Page text of an HTML page: scripts, styles, comments and tags dropped."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return strip(F.regexp_replace(text, r"\s+", " "))
