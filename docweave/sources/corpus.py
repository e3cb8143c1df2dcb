"""Corpora: DataFrames of (doc_ord, doc VARIANT), one object a row, with its text where there is one.

``doc_ord`` numbers documents and comes from the data: the place in the array,
or a number that the caller gives. A line of NDJSON has no place that Spark
keeps across reads, so its number is a hash of its text with a count among equal
texts; it is stable, not consecutive.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..expressions import elements, kind_of, let


def strict(text: Column) -> Column:
    """The variant of a JSON text, or null where the text is not exactly one JSON value.

    Spark's parser refuses repeated members, trailing commas and leading zeros,
    but ignores what follows a value. So the text is parsed as the first of two
    elements, before a hash of itself: a text that ends the value, or the array,
    on its own cannot have its own hash in second place.
    """
    mark = F.xxhash64(text, F.length(text))
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    return let(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "bigint") == mark, F.try_variant_get(v, "$[0]", "variant")))


def checked(text: Column) -> Column:
    """The variant of a JSON text; raises where the text is not exactly one JSON value."""
    message = F.concat(F.lit("invalidJson: "), F.substring(F.coalesce(text, F.lit("null")), 1, 200))
    # the parser's own error says which member is repeated; what it lets through has something after the value
    return F.coalesce(strict(text), F.when(F.parse_json(text).isNotNull() | text.isNull(), F.raise_error(message).cast("variant")))


def first_repeat(text: str) -> tuple[str, str] | None:
    """(path, name) of the first member that an object repeats, outer objects first; None if the text is not JSON otherwise."""
    def within(value: object, at: str) -> tuple[str, str] | None:
        if isinstance(value, list):
            return next((f for v in value if (f := within(v, f"{at}[]"))), None)
        if not isinstance(value, tuple):
            return None
        seen: set[str] = set()
        for name, _ in value:
            if name in seen:
                return at or ".", name
            seen.add(name)
        return next((f for name, v in value if (f := within(v, f"{at}.{name}"))), None)

    def refused(_: str) -> None:
        raise ValueError

    try:
        return within(json.loads(text, object_pairs_hook=tuple, parse_constant=refused), "")
    except (ValueError, RecursionError):
        return None


def refusals(df: DataFrame, doc: str = "value", doc_ord: str = "doc_ord") -> DataFrame:
    """doc_ord, code, path, name of every text that is not one JSON object without repeated members. Only these texts reach Python."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [first_repeat(t) if t is not None else None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_ord": b.column(0), "code": pa.array(["duplicateMember" if f else "invalidJson" for f in found], pa.string()),
                                              "path": pa.array([f and f[0] for f in found], pa.string()), "name": pa.array([f and f[1] for f in found], pa.string())})

    rows = df.select(F.col(doc_ord).cast("long").alias("doc_ord"), F.col(doc).alias("value"), let(strict(F.col(doc)), lambda v: F.when(v.isNull(), "none").otherwise(kind_of(v))).alias("kind"))
    none = F.lit(None).cast("string")
    shape = rows.where("kind in ('A', 'S')").select("doc_ord", F.lit("arrayElementNotObject").alias("code"), none.alias("path"), none.alias("name"))
    return shape.unionByName(rows.where("kind = 'none'").select("doc_ord", "value").mapInArrow(told, "doc_ord long, code string, path string, name string"))


def from_rows(df: DataFrame, doc: str = "value", doc_ord: str = "doc_ord") -> DataFrame:
    """Documents as JSON text, one object a row, with a number. The text stays beside what it is parsed to."""
    return df.select(F.col(doc_ord).cast("long").alias("doc_ord"), checked(F.col(doc)).alias("doc"), F.col(doc).alias("text"))


#: Lines that occur more than once, up to which their hashes are broadcast.
FEW = 1 << 18


def numbered(lines: DataFrame) -> DataFrame:
    """value, doc_ord: a hash of the line and of its number among lines of the same hash.

    Only lines whose hash occurs again are shuffled. Their numbers are prefix sums
    over the parts that they are read in, so that no task numbers all copies.
    """
    rows = lines.select("value", F.xxhash64("value").alias("h"), F.spark_partition_id().alias("part"))
    parts = rows.groupBy("h", "part").agg(F.count("*").alias("n"))
    again = parts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else again
    earlier = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.join(again, "h", "left_semi").select("h", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("value"))
    some = rows.join(again, "h", "left_semi").withColumn("nth", nth).join(before, ["h", "part"])
    one = rows.join(again, "h", "left_anti").select(F.xxhash64("h", F.lit(1).cast("long")).alias("doc_ord"), "value")
    return one.unionByName(some.select(F.xxhash64("h", (F.col("before") + F.col("nth")).cast("long")).alias("doc_ord"), "value"))


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; splittable, so the form for large corpora."""
    return from_rows(numbered(spark.read.text(path).where(F.trim("value") != "")))


def from_value(df: DataFrame, value: str = "value") -> DataFrame:
    """A whole corpus in one text: an object, or an array of objects."""
    whole = df.select(checked(F.col(value)).alias("v")).withColumn("k", kind_of(F.col("v")))
    each = whole.select(F.posexplode(F.when(F.col("k") == "A", elements(F.col("v"))).otherwise(F.array("v"))).alias("doc_ord", "doc"), "k")
    bad = F.when(F.col("k") == "S", F.raise_error(F.lit("notObjectOrArray"))).when(kind_of(F.col("doc")) != "O", F.raise_error(F.concat(F.lit("arrayElementNotObject: "), F.col("doc_ord").cast("string"))))
    return each.where(F.coalesce(bad.cast("boolean"), F.lit(True))).select(F.col("doc_ord").cast("long").alias("doc_ord"), "doc")


def json_file(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one array of objects, or one object. One file is one task; use ``ndjson`` for large corpora."""
    return from_value(spark.read.text(path, wholetext=True))


def text(spark: SparkSession, value: str) -> DataFrame:
    """A corpus given as a string, such as standard input."""
    return from_value(spark.createDataFrame([(value,)], "value string"))


def refusal(error: Exception) -> Refused | None:
    """The refusal that an error raised while reading stands for."""
    said = str(error)
    for code in ("notObjectOrArray", "arrayElementNotObject", "invalidJson"):
        if code in said:
            return Refused(code)
    if "VARIANT_DUPLICATE_KEY" in said:
        name = re.search(r"duplicate object key `(.*?)`", said)
        return Refused("duplicateMember", "", name[1] if name else "")
    return Refused("invalidJson") if "MALFORMED_RECORD" in said else None
