"""Shredded tables on disk or in a database, with their schema beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import ZERO, enforced
from ..plans.layout import Layout


def written(tables: dict[str, DataFrame], layout: Layout, folder: str, mode: str = "errorifexists") -> None:
    """One Parquet folder a table, checked against the contract as it is written, and the schemas as text."""
    spark = next(iter(tables.values())).sparkSession
    for t in layout.ordered():
        enforced(tables[t.name], t).write.mode(mode).parquet(f"{folder}/{t.name}")
    text = [(json.dumps({"tables": layout.schema_json(), "ddl": layout.ddl(), "constraints": layout.constraints()}),)]
    spark.createDataFrame(text, "value string").coalesce(1).write.mode(mode).text(f"{folder}/_schema")


def schemas(spark: SparkSession, folder: str) -> dict[str, T.StructType]:
    """The layout that was written: nullability, keys and references included."""
    found = json.loads(spark.read.text(f"{folder}/_schema").first()[0])["tables"]
    return {name: T.StructType.fromJson(json.loads(s)) for name, s in found.items()}


def opened(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables, their total columns not nullable again. Parquet readers make every column nullable; a default that is never met takes that back."""
    out = {}
    for name, struct in schemas(spark, folder).items():
        df = spark.read.schema(struct).parquet(f"{folder}/{name}")
        out[name] = df.select(*[F.col(f"`{f.name}`") if f.nullable else F.coalesce(F.col(f"`{f.name}`"), F.lit(ZERO[type(f.dataType)]).cast(f.dataType)).alias(f.name) for f in struct])
    return out


def to_database(tables: dict[str, DataFrame], layout: Layout, url: str, options: dict[str, str] | None = None, batch: int = 1000) -> None:
    """Tables in a database that JDBC reaches, rows in batches; constraints are the caller's to add afterwards, from ``layout.constraints()``."""
    for t in layout.ordered():
        tables[t.name].write.format("jdbc").options(url=url, dbtable=t.name, batchsize=str(batch), **(options or {})).mode("overwrite").save()


def from_database(spark: SparkSession, url: str, table: str, columns: list[str], options: dict[str, str] | None = None) -> DataFrame:
    """Columns of a table that JDBC reaches; only these are read, and filters on the result are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load().select(*columns)


def logged(spark: SparkSession, folder: str, run: dict) -> None:
    """Appends a benchmark run as a line of JSON."""
    spark.createDataFrame([(json.dumps(run, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(folder)


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder)
