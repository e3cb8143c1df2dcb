"""Column types and their least upper bounds.

bot < int < float, bot < uuid < str, bot < bool; ref and coll stand for nested
objects and collections and go with nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

TAGS = ("bot", "int", "float", "uuid", "str", "bool", "ref", "coll")
ABOVE = {"int": {"float"}, "uuid": {"str"}}
#: The largest integer that is an int; beyond it a number is a float.
INT_BOUND = (1 << 62) - 1
SPARK = {"bot": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "uuid": T.StringType(), "str": T.StringType(), "bool": T.BooleanType()}
SQL = {"bot": "text", "int": "bigint", "float": "double precision", "uuid": "uuid", "str": "text", "bool": "boolean"}


def at_most(a: str, b: str) -> bool:
    return a == b or a == "bot" or b in ABOVE.get(a, ())


def join(a: str, b: str) -> str | None:
    """The least type above both, or None."""
    return b if at_most(a, b) else a if at_most(b, a) else None


def join_all(tags: Iterable[str]) -> str | None:
    out: str | None = "bot"
    for tag in sorted(tags):
        out = out and join(out, tag)
    return out
