"""Kinds of JSON values, and values as Python's ``str`` writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwright.functions.text import bind

STRING, LIST, OBJECT, BOOLEAN, NUMBER, NULL = "string", "list", "object", "boolean", "number", "null"


def kind_of(value: Column) -> Column:
    """Kind of a variant; a missing value is ``null``."""
    return bind(
        F.schema_of_variant(value),
        lambda name: F.when(name.isNull() | (name == "VOID"), NULL)
        .when(name == "STRING", STRING)
        .when(name == "BOOLEAN", BOOLEAN)
        .when(name.startswith("ARRAY"), LIST)
        .when(name.startswith("OBJECT"), OBJECT)
        .otherwise(NUMBER),
    )


def kind_at(value: Column, path: str) -> Column:
    """Kind of what lies at ``path`` in a variant."""
    return kind_of(F.try_variant_get(value, path, "variant"))


def _scalar(kind: Column, text: Column) -> Column:
    """``str`` of a scalar: ``True``, ``None``, decimals without trailing zeros."""
    decimal = F.regexp_replace(text, r"^(-?\d+\.\d*?\d)0+$", "$1")
    return (
        F.when((kind == NULL) | text.isNull(), "None")
        .when(kind == BOOLEAN, F.initcap(text))
        .when(kind == NUMBER, decimal)
        .otherwise(text)
    )


def _quoted(kind: Column, text: Column) -> Column:
    """``repr`` of a scalar: strings in single quotes, in double ones around a single one."""
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), text, F.lit('"'))
    quoted = F.when(text.contains("'") & ~text.contains('"'), double).otherwise(single)
    return F.when(kind == STRING, quoted).otherwise(_scalar(kind, text))


def items(text: Column) -> Column:
    """``array<struct<kind, text>>`` of a JSON list."""
    kinds = F.transform(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), kind_of)
    return F.zip_with(
        kinds, F.from_json(text, "array<string>"), lambda k, t: F.struct(k.alias("kind"), t.alias("text"))
    )


def entries(text: Column) -> Column:
    """``array<struct<key, kind, text>>`` of a JSON object, in its order."""
    variants = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    return bind(
        variants,
        lambda known: F.transform(
            pairs,
            lambda e: F.struct(
                e["key"].alias("key"), kind_of(F.element_at(known, e["key"])).alias("kind"), e["value"].alias("text")
            ),
        ),
    )


def python_text(kind: Column, text: Column) -> Column:
    """``str`` of a value given by kind and text; what a list or object holds is written as
    ``repr`` does, what these hold in turn as JSON."""
    listed = F.array_join(F.transform(items(text), lambda x: _quoted(x["kind"], x["text"])), ", ")
    keyed = F.transform(
        entries(text), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), _quoted(e["kind"], e["text"]))
    )
    return (
        F.when(kind == LIST, F.concat(F.lit("["), listed, F.lit("]")))
        .when(kind == OBJECT, F.concat(F.lit("{"), F.array_join(keyed, ", "), F.lit("}")))
        .otherwise(_scalar(kind, text))
    )
