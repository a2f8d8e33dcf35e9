"""Typed reads from VARIANT values."""

from pyspark.sql import Column, functions as F

from nearshelf.functions.text import lenient_double, let, text_or_null


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def text_at(v: Column, path: str) -> Column:
    """Stripped non-blank string at the path; every other type is null."""
    return let(
        F.try_variant_get(v, path, "variant"),
        lambda at: F.when(kind(at) == "STRING", text_or_null(F.try_variant_get(at, "$", "string"))),
    )


def double_at(v: Column, path: str) -> Column:
    """Number at the path: a JSON number, a boolean, or a numeric string."""
    return let(
        F.try_variant_get(v, path, "variant"),
        lambda at: F.when(kind(at) == "STRING", lenient_double(F.try_variant_get(at, "$", "string")))
        .otherwise(F.try_variant_get(at, "$", "double")),
    )


def items_at(v: Column, path: str) -> Column:
    """Array elements at the path, null when there is no array."""
    return F.try_variant_get(v, path, "array<variant>")


def parse_twice(text: Column) -> Column:
    """Parsed JSON; a JSON string holding JSON is parsed once more."""
    once = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    return F.when(is_string(once), inner).otherwise(once)
