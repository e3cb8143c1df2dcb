"""Queries and facts over shredded tables, by Spark's own parser and analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame


def select(text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A SELECT over tables by name; Spark SQL semantics, NULL comparisons included."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def facts(df: DataFrame) -> dict[str, tuple[str, str]]:
    """For each output column whether it is a constant, and whether it can be NULL, as Catalyst's optimizer found."""
    plan = df._jdf.queryExecution().optimizedPlan()
    out = {}
    folded = {}
    if plan.nodeName() == "Project":
        for i in range(plan.projectList().size()):
            e = plan.projectList().apply(i)
            inner = e.child() if e.nodeName() == "alias" or e.prettyName() == "alias" else e
            folded[e.name()] = inner.toString() if inner.foldable() else None
    for i in range(plan.output().size()):
        a = plan.output().apply(i)
        out[a.name()] = (folded.get(a.name()) or "unknown", "may be null" if a.nullable() else "not null")
    return out
