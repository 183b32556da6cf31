"""Reading of JSON values by their types: a value of another type is null, and takes nothing else with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A JSON text as a variant; null for no JSON, also where something follows the value.

    The parser stops after a value, so the text is also read inside an array, which must then hold it alone, and as an object's value: what follows cannot close both.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull() & (F.size(listed) == 1)
    return F.when(whole, F.get(listed, 0))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def items(value: Column, path: str = "$") -> Column:
    """The elements of an array as variants; null for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def objects(value: Column, path: str = "$") -> Column:
    """The objects among an array's elements, in order; other elements are passed over."""
    return F.filter(items(value, path), is_object)


def text_at(value: Column, path: str) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind(found) == "STRING", F.try_variant_get(value, path, "string"))


def number_at(value: Column, path: str, as_type: str = "double") -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind(found).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, path, as_type))


def whole_at(value: Column, path: str) -> Column:
    """A whole number; null for 1.5 as for "1"."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind(found) == "BIGINT", F.try_variant_get(value, path, "bigint"))


def other_at(value: Column, path: str, wanted: str) -> Column:
    """Whether there is a value, neither missing nor null, of another type than ``wanted``."""
    found = F.try_variant_get(value, path, "variant")
    return F.coalesce(~kind(found).isin(wanted, "VOID"), F.lit(False))
