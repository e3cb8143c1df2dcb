"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def elements(value: Column) -> Column:
    """The elements of a variant that is an array; null for any other."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """The members of a variant that is an object, by name; null for any other."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind_of(value: Column) -> Column:
    """O, A or S: object, array or scalar. Casts that copy nothing tell; the schema, or the elements, would be those of all within."""
    return F.when(F.try_variant_get(value, "$", "struct<_:boolean>").isNotNull(), "O").when(F.try_variant_get(value, "$", "array<boolean>").isNotNull(), "A").otherwise("S")
