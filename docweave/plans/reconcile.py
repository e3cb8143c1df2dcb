"""The same aggregates from nested documents and from flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import Flat, Levels, Nested


def from_nested(store: Nested) -> DataFrame:
    lv = store.levels
    c1, c2, _ = lv.members
    first = store.records.select(F.explode(f"d.{c1}").alias("a"))
    second = first.select(F.explode(f"a.{c2}").alias("b"))
    return combined([store.records.agg(F.count("*").alias("n0")), first.agg(F.count("*").alias("n1")), second.agg(F.count("*").alias("n2")), leaf_sums(store.leaves(), lv)])


def from_flat(store: Flat) -> DataFrame:
    return combined([store.root.agg(F.count("*").alias("n0")), store.first.agg(F.count("*").alias("n1")), store.second.agg(F.count("*").alias("n2")), leaf_sums(store.leaf, store.levels)])


def leaf_sums(leaves: DataFrame, lv: Levels) -> DataFrame:
    m = F.col(lv.measure)
    return leaves.agg(F.count("*").alias("n3"), F.coalesce(F.sum(m), F.lit(0)).alias("measure"), F.count(lv.group).alias("named"), F.coalesce(F.sum(m * F.col(lv.rate).cast("double")), F.lit(0.0)).alias("weighted"))


def combined(rows: list[DataFrame]) -> DataFrame:
    """One row out of several one-row frames."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(r)
    return out


def differences(nested: Nested, flat: Flat) -> dict[str, tuple]:
    a, b = from_nested(nested).first().asDict(), from_flat(flat).first().asDict()
    return {k: (a[k], b[k]) for k in a if abs(a[k] - b[k]) > 1e-9 * max(1.0, abs(a[k]))}
