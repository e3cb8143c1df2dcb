"""The engine's registered queries, over whole tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpora
from .functions.select import select
from .operators.contract import enforced, orphans
from .operators.handles import handles
from .operators.reassemble import nested
from .operators.shred import records_of_texts, shredded
from .plans.infer import Inference, infer
from .plans.layout import Layout, laid_out
from .plans.reconcile import from_flat, from_nested
from .plans.report import middle_id
from .plans.stores import Flat, Nested, Raw, sweep
from .sources.corpus import from_rows, refusals
from .streaming.incremental import Incremental

Query = Callable[[SparkSession, str], DataFrame]
OVER, ORG, ID, UNKNOWN = 3_000_000, "BUILDING", 7, -1
SWEEP = [0, 100_000, 500_000, 1_000_000, 3_000_000, 5_000_000, 9_000_000]

def inference(spark: SparkSession, folder: str, name: str) -> Inference:
    """The schema of a corpus, from all of its documents."""
    return infer(from_rows(getattr(corpora, name)(spark, folder)), getattr(corpora, f"{name.upper()}_CONFIG"))


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="docweave-")
    return f"{at.rstrip('/')}/docweave-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; removed when the session ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Removes what ``kept`` wrote and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already closing; the folder is the cluster's to clear
        return


def tables(spark: SparkSession, folder: str, name: str) -> tuple[dict[str, DataFrame], Layout]:
    """The tables of a corpus. Its texts are built once, observed, and read once into records, which all tables are taken from."""
    texts = kept(getattr(corpora, name)(spark, folder))
    layout = laid_out(infer(from_rows(texts), getattr(corpora, f"{name.upper()}_CONFIG")))
    out = shredded(kept(records_of_texts(texts, layout)), layout)
    forgotten(texts)
    return {n: enforced(df, layout.by_name()[n]) for n, df in out.items()}, layout


def columns(name: str) -> Query:
    return lambda spark, folder: inference(spark, folder, name).columns_frame(spark)


def raw(spark: SparkSession, folder: str) -> Raw:
    return Raw(corpora.customers(spark, folder), corpora.CUSTOMERS)


def records(spark: SparkSession, folder: str) -> Nested:
    record = F.from_json("value", corpora.CUSTOMERS.record())
    return Nested(corpora.customers(spark, folder).select(record.alias("d")), corpora.CUSTOMERS)


def flat(spark: SparkSession, folder: str) -> Flat:
    return Flat(tables(spark, folder, "customers")[0], corpora.CUSTOMERS)


def shred_orders(spark: SparkSession, folder: str) -> DataFrame:
    return tables(spark, folder, "customers")[0]["orders"].select("id", "customer_id", "idx", "cents", "status")


def shred_items(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "customers")[0]
    up = t["shipments"].select(F.col("id").alias("s"), "orders_id", F.col("status").alias("line_status"))
    return t["items"].join(up, F.col("shipments_id") == F.col("s")).select("orders_id", "line_status", "idx", "line", "name", "cents", "bp")


def shred_turns(spark: SparkSession, folder: str) -> DataFrame:
    return tables(spark, folder, "turns")[0]["turn"].select("conversation_id", "idx", "role", "text")


def shred_props_map(spark: SparkSession, folder: str) -> DataFrame:
    return tables(spark, folder, "events")[0]["props"].select("event_id", "key", "value")


def shred_label_reference(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "labelled")[0]
    label = t["label"].select(F.col("id").alias("l"), "quality", "toxic")
    return t["document"].join(label, F.col("label") == F.col("l")).select("id", "lang", "quality", "toxic")


def shred_items_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return tables(spark, folder, "lone")[0]["item"].select("purchase_id", "idx", "line", "cents")


def shred_values(spark: SparkSession, folder: str) -> DataFrame:
    return tables(spark, folder, "vectors")[0]["embedding"].select("vector_id", "idx", F.col("value").cast("float").cast("double").alias("value"))


def reassemble_totals(spark: SparkSession, folder: str) -> DataFrame:
    t, layout = tables(spark, folder, "customers")
    whole = nested(t, layout, {"customer": ["id"], "orders": [], "shipments": [], "items": ["cents"]})
    first = F.col("orders")
    second = F.flatten(F.transform(first, lambda o: o["shipments"]))
    third = F.flatten(F.transform(second, lambda s: s["items"]))
    return whole.select("id", *[F.size(c).cast("long").alias(f"n{i + 1}") for i, c in enumerate((first, second, third))],
                        F.aggregate(third, F.lit(0).cast("long"), lambda a, x: a + x["cents"]).alias("total"))


def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(*tables(spark, folder, "customers"))


def childless_parents(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "customers")[0]
    return t["orders"].join(t["shipments"].select(F.col("orders_id").alias("o")), F.col("id") == F.col("o"), "left_anti").select("id")


def nullability_identity(spark: SparkSession, folder: str) -> DataFrame:
    c = inference(spark, folder, "events").columns_frame(spark)
    wrong = (F.col("n_values") + F.col("nulls") + F.col("absent") != F.col("visits")) | (F.col("nullable") != (F.col("n_values") < F.col("visits")))
    return c.agg(F.count("*").alias("columns"), F.count(F.when(wrong, 1)).alias("violations"))


def infer_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Three parts of the corpus observed in turn, the last first."""
    corpus, store = from_rows(corpora.events(spark, folder)), scratch(spark)
    for part in (2, 0, 1, 2):  # by another process each; the last batch is delivered twice
        Incremental(spark, store, corpora.EVENTS_CONFIG).add(corpus.where(F.pmod("doc_ord", F.lit(3)) == part), part)
    return Incremental(spark, store, corpora.EVENTS_CONFIG).inference().columns_frame(spark)


def refused_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are no documents, each with what is wrong and where."""
    return refusals(corpora.broken(spark, folder))


def fk_orphans_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans where every tenth order is gone."""
    t, layout = tables(spark, folder, "customers")
    return orphans(t | {"orders": t["orders"].where("id % 10 <> 0")}, layout)


def handle_get(spark: SparkSession, folder: str) -> DataFrame:
    return handles(*tables(spark, folder, "customers"))["orders"].get(ID).select("id", "customer_id", "status", "cents")


def handle_of_parent(spark: SparkSession, folder: str) -> DataFrame:
    return handles(*tables(spark, folder, "customers"))["orders"].of_parent(ID).select("id", "idx", "cents")


def shred_names_alike(spark: SparkSession, folder: str) -> DataFrame:
    """Members whose names differ in case only, as columns of their own."""
    return tables(spark, folder, "alike")[0]["nation"].select("id", "name", F.col("f___4eame").alias("other"), F.col("f___4e_41_4d_45").alias("third"))


def middle_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order in the middle by id."""
    return spark.createDataFrame([(middle_id(tables(spark, folder, "customers")[0]["orders"]),)], "id long")


def by_name_nonpositive(spark: SparkSession, folder: str) -> DataFrame:
    """The grouped maximum over a measure that can be negative: customers' balances by customer."""
    c = corpora.table(spark, folder, "customer").select(F.col("c_name").alias("name"), corpora.cents("c_acctbal").alias("cents"))
    return c.groupBy("name").agg(F.max("cents").alias("largest")).where("largest > 0")


SELECTS = {
    "eq": "select id, cents from orders where status = 'F'",
    "ne": "select id, cents from orders where status <> 'F'",
    "lt": "select id, cents from orders where cents < 5000000",
    "le": "select id, cents from orders where cents <= 5000000",
    "gt": "select id, cents from orders where cents > 40000000",
    "ge": "select id, cents from orders where cents >= 40000000",
    "star": "select * from customer",
    "quote": "select id from customer where name = 'it''s'",
}


def select_(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        t = tables(spark, folder, "customers")[0]
        return select(SELECTS[name], {n: t[n] for n in ("orders", "customer")})
    return query


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"infer_columns_{n}": columns(n) for n in ("customers", "events", "labelled", "lone", "vectors", "alike", "marks")}
    for f in (shred_orders, shred_items, shred_turns, shred_props_map, shred_label_reference, shred_items_collapsed, shred_values, reassemble_totals, fk_orphans, childless_parents, nullability_identity, infer_incremental, by_name_nonpositive,
              refused_by_code, fk_orphans_found, handle_get, handle_of_parent, shred_names_alike, middle_order):
        out[f.__name__] = f
    for name, store in (("raw", raw), ("nested", records), ("flat", flat)):
        out |= {
            f"scan_{name}": lambda s, d, store=store: store(s, d).scan(OVER),
            f"computed_{name}": lambda s, d, store=store: store(s, d).computed(OVER),
            f"by_name_{name}": lambda s, d, store=store: store(s, d).by_name(),
            f"document_{name}": lambda s, d, store=store: store(s, d).document(ID),
            f"three_hop_{name}": lambda s, d, store=store: store(s, d).three_hop(ORG),
        }
    out |= {
        "document_semi": lambda s, d: flat(s, d).document_semi(ID),
        "three_hop_semi": lambda s, d: flat(s, d).three_hop_semi(ORG),
        "document_unknown": lambda s, d: flat(s, d).document(UNKNOWN),
        "sweep": lambda s, d: sweep(flat(s, d).leaf, corpora.CUSTOMERS, SWEEP),
        "reconcile": lambda s, d: from_flat(flat(s, d)),
        "reconcile_nested": lambda s, d: from_nested(records(s, d)),
    }
    return out | {f"select_where_{n}": select_(n) for n in SELECTS}
