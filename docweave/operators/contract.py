"""The inferred contract, held against shredded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MESSAGES, Refused
from ..lattice import SPARK
from ..plans.layout import Layout, TableLayout

ZERO = {T.LongType: 0, T.DoubleType: 0.0, T.StringType: "", T.BooleanType: False}


def total(name: str, type_: T.DataType) -> Column:
    """The column, not nullable; a NULL raises."""
    message = F.lit(f"{name}: {MESSAGES['nullInTotalColumn']}")
    return F.coalesce(F.col(f"`{name}`"), F.raise_error(message).cast(type_), F.lit(ZERO[type(type_)]).cast(type_)).alias(name)


def enforced(df: DataFrame, t: TableLayout) -> DataFrame:
    """The table with its total columns not nullable. Cache or write the result: a count alone would prune the checks."""
    return df.select(*[F.col(f"`{f.name}`") if f.nullable else total(f.name, SPARK[f.type]) for f in t.fields])


def null_counts(df: DataFrame, t: TableLayout) -> dict[str, int]:
    """NULLs in each total column, in one pass."""
    must = [f.name for f in t.fields if not f.nullable]
    row = df.agg(*[F.sum(F.col(f"`{n}`").isNull().cast("long")).alias(n) for n in must]).first()
    return {n: row[n] or 0 for n in must}


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("id").count().where("count > 1")


def orphans(tables: dict[str, DataFrame], layout: Layout) -> DataFrame:
    """table_name, column_name, orphans for every reference: rows whose target does not exist."""
    out = None
    for t in layout.ordered():
        for f in t.fields:
            if f.refers is None:
                continue
            target = tables[layout.tables[f.refers].name].select(F.col("id").alias("_target"))
            left = tables[t.name].where(F.col(f"`{f.name}`").isNotNull()).select(F.col(f"`{f.name}`").alias("_ref"))
            one = left.join(target, F.col("_ref") == F.col("_target"), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(t.name).alias("table_name"), F.lit(f.name).alias("column_name"), "orphans")
            out = one if out is None else out.unionByName(one)
    return out


def verified(tables: dict[str, DataFrame], layout: Layout) -> None:
    """Raises at the first broken promise: NULL in a total column, a repeated key, an orphan."""
    for t in layout.ordered():
        for name, n in null_counts(tables[t.name], t).items():
            if n:
                raise Refused("nullInTotalColumn", f"{t.name}.{name}", f"{n} rows")
        if duplicate_keys(tables[t.name]).limit(1).count():
            raise Refused("duplicateKey", t.name)
    found = orphans(tables, layout)
    bad = found.where("orphans > 0").first() if found is not None else None
    if bad:
        raise Refused("orphan", f"{bad['table_name']}.{bad['column_name']}", f"{bad['orphans']} rows")
