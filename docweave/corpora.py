"""Document corpora built by Spark from the relational tables: (doc_ord, value JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.stores import Levels


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def moved(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled once by ``key``, in rows: groups by it, and by it and more, then need no shuffle of half-built arrays."""
    return df.repartition(partitions(df.sparkSession), key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


#: Customers hold orders, these shipments, these items.
CUSTOMERS = Levels(("customer", "orders", "shipments", "items"), ("orders", "shipments", "items"), "segment", "name", "cents", "bp")
CUSTOMERS_CONFIG = {"root": "customer", "names": {".orders[]": "orders", ".orders[].shipments[]": "shipments", ".orders[].shipments[].items[]": "items"}}


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Four levels. An order without line items has no shipments, a customer without orders no orders."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("name"), cents("l_extendedprice").alias("cents"), cents("l_discount").alias("bp"))
    place = F.struct("l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", item.alias("item"))
    lines = moved(table(spark, folder, "lineitem").select("l_orderkey", place.alias("place")), "l_orderkey")
    # an order's lines are gathered and sorted once, by status first, and then cut by status
    places = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("place")).alias("places"))
    items = lambda status: F.transform(F.filter("places", lambda x: x["l_linestatus"].eqNullSafe(status)), lambda x: x["item"])
    by_order = places.select("l_orderkey", F.transform(F.array_distinct(F.col("places.l_linestatus")), lambda s: F.struct(s.alias("status"), items(s).alias("items"))).alias("shipments"))
    orders = table(spark, folder, "orders").join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), cents("o_totalprice").alias("cents"), "shipments")
    by_customer = moved(orders.select("o_custkey", order.alias("order")), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("order")).alias("orders"))
    rows = table(spark, folder, "customer").join(by_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    doc = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "orders")
    return rows.select(F.col("c_custkey").alias("doc_ord"), F.to_json(doc).alias("value"))


EVENTS_CONFIG = {"root": "event", "maps": [".props"], "names": {".props": "props"}}


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A map of data keys, and a note that is null, absent or text by turns."""
    e = table(spark, folder, "events")
    head = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), cents("value").alias("cents")))
    note = F.when(F.col("event_id") % 3 == 0, ',"note":null').when(F.col("event_id") % 3 == 1, "").otherwise(',"note":"n"')
    return e.withColumn("h", head).select(
        F.col("event_id").alias("doc_ord"), F.concat(F.substring("h", F.lit(1), F.length("h") - 1), note, F.lit(',"props":'), F.col("props"), F.lit("}")).alias("value"))


LABELLED_CONFIG = {"root": "document", "names": {".label": "label"}}


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """A nested object that some documents have, beside their whole text."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "text")
    one = table(spark, folder, "labels").select(F.col("doc_id").alias("l"), F.struct("quality", "toxic").alias("label"))
    doc = F.struct(F.col("doc_id").alias("id"), "lang", "label", "text")
    return d.join(one, F.col("doc_id") == F.col("l"), "left").select(F.col("doc_id").alias("doc_ord"), F.to_json(doc).alias("value"))


LONE_CONFIG = {"root": "purchase", "names": {".items": "item"}}


def lone(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose items are an object if there is one, and an array otherwise."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_linenumber").alias("line"), cents("l_extendedprice").alias("cents")).alias("item"))
    lines = moved(table(spark, folder, "lineitem").select("l_orderkey", item.alias("place")), "l_orderkey")
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("place"))["item"].alias("items"))
    rows = table(spark, folder, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    held = F.when(F.size("items") == 1, F.to_json(F.get("items", F.lit(0)))).when(F.size("items") > 1, F.to_json("items")).otherwise("[]")
    return rows.select(F.col("o_orderkey").alias("doc_ord"), F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"items":'), held, F.lit("}")).alias("value"))


VECTORS_CONFIG = {"root": "vector", "names": {".embedding": "embedding"}}


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """An array of numbers."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_ord"), F.to_json(F.struct(F.col("vec_id").alias("id"), "label", "embedding")).alias("value"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as arrays of turns."""
    t = table(spark, folder, "conversations")
    many = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return many.select(F.col("conv_id").alias("doc_ord"), F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("value"))


TURNS_CONFIG = {"root": "conversation", "names": {".turns": "turn"}}


def broken(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, of which six in seven are no JSON object, or repeat a member."""
    c = table(spark, folder, "customer").withColumn("h", F.to_json(F.struct(F.col("c_custkey").alias("id"))))
    ways = ["{h}", "{h} x", "{h}] x", '{"id":1,"at":{"n":1,"n":2}}', "[{h}]", '{"xs":[{"k":{"id":1,"id":1}}]}', '{"id":1,}']
    value = F.lit(ways[0])
    for k, way in enumerate(ways):
        value = F.when(F.col("c_custkey") % 7 == k, way).otherwise(value)
    return c.select(F.col("c_custkey").alias("doc_ord"), F.replace(value, F.lit("{h}"), F.col("h")).alias("value"))


ALIKE_CONFIG = {"root": "nation"}


def alike(spark: SparkSession, folder: str) -> DataFrame:
    """Members whose names differ in case only."""
    n = table(spark, folder, "nation")
    text = F.concat(F.lit('{"id":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"'), F.col("n_name"), F.lit('","Name":'), F.col("n_regionkey").cast("string"), F.lit(',"NAME":true}'))
    return n.select(F.col("n_nationkey").cast("long").alias("doc_ord"), text.alias("value"))


MARKS_CONFIG = {"root": "mark"}


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """Strings in the form of a uuid in one member, and among others in another; integers of any size, and fractions."""
    c = table(spark, folder, "customer").withColumn("h", F.md5("c_name"))
    part = lambda at, n: F.substring("h", at, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    some = F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(uuid)
    big = F.when(F.col("c_custkey") % 3 == 0, "9223372036854775807").when(F.col("c_custkey") % 3 == 1, "7").otherwise("0.5")
    text = F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), F.lit(',"key":"'), uuid, F.lit('","some":"'), some, F.lit('","n":'), big, F.lit("}"))
    return c.select(F.col("c_custkey").cast("long").alias("doc_ord"), text.alias("value"))
