"""Exact duplicates, with frequent digests kept out of the shuffle.

Misra-Gries summaries, one a partition and then merged, name every digest that
holds more than ``1 / (counters + 1)`` of the rows, and perhaps some others. An
exact count settles each of these, and the at most ``counters`` survivors are
broadcast, so that rows of a hot group find their winner where they are read.
All other digests are few rows each and go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, small, stored, text_of, unused

COUNTERS = 1024


def merged(counts: dict, more: dict, counters: int) -> dict:
    """The Misra-Gries summary of two: sums, less the first sum that has no counter."""
    for k, n in more.items():
        counts[k] = counts.get(k, 0) + n
    if len(counts) <= counters:
        return counts
    less = sorted(counts.values(), reverse=True)[counters]
    return {k: n - less for k, n in counts.items() if n > less}


def summary(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    counts: dict = {}
    for b in batches:
        seen = b.column(0).value_counts()
        counts = merged(counts, dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)), counters)
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` rows (digest): all that hold over 1 / (counters + 1) of the rows are among them."""
    local = digests.select("digest").mapInArrow(lambda it: summary(it, counters), "digest string, n long")
    top = local.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1)
    rows = top.collect()  # at most counters + 1
    less = rows[counters]["n"] if len(rows) > counters else 0
    kept = [(r["digest"],) for r in rows if r["n"] > less]
    return digests.sparkSession.createDataFrame(kept, "digest string")


def digest_of(text: str, normalise: Column | None) -> Column:
    """SHA-256 of a text as UTF-8; null counts as empty."""
    return F.sha2((text_of(text) if normalise is None else F.coalesce(normalise, F.lit(""))).cast("binary"), 256)


def settled(docs: DataFrame, text: str, doc_id: str, keep: str, normalise: Column | None, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, winners, rest): all rows by digest; keep_id and group_size of the heavy digests, no more than ``counters`` rows; and of every row of the others."""
    best = {"max": F.max, "min": F.min}[keep]
    digests = stored(docs.select(column(doc_id).alias("doc_id"), digest_of(text, normalise).alias("digest")), "digests")
    heavy = F.broadcast(heavy_digests(digests, counters))
    winners = digests.join(heavy, "digest", "left_semi").groupBy("digest").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    group = Window.partitionBy("digest")
    rest = digests.join(heavy, "digest", "left_anti").select("digest", "doc_id", best("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"))
    return digests, winners, rest


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", normalise: Column | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty text; texts of any length are read whole, by their digest.
    The row with the largest (or, by ``keep``, smallest) id of a group stays; a
    tie is rows that repeat that id, and all of these are ``kept``. A null id
    never wins over another; a group of null ids only has keep_id null and keeps
    its rows. Other columns, whatever their names, are ignored; an empty table
    gives no rows.
    """
    digests, winners, rest = settled(docs, text, doc_id, keep, normalise, counters)
    hot = digests.join(F.broadcast(winners), "digest")
    return hot.select("digest", "doc_id", "keep_id", "group_size").unionByName(rest).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", normalise: Column | None = None, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns and no others.

    Rows of heavy digests are removed where they are read. Of the others only
    the ids and digests that go are joined back, by broadcast if they are few.
    """
    _, winners, rest = settled(docs, text, doc_id, keep, normalise, counters)
    digest, keep_id, gone_id, gone_digest = unused(docs, "_digest", "_keep_id", "_gone_id", "_gone_digest")
    hot = winners.select(F.col("digest").alias(gone_digest), F.col("keep_id").alias(keep_id))
    # the digest of a row without a winner has none to join
    rows = docs.withColumn(digest, digest_of(text, normalise)).join(F.broadcast(hot), F.col(digest) == F.col(gone_digest), "left")
    rows = rows.where(F.col(gone_digest).isNull() | column(doc_id).eqNullSafe(F.col(keep_id))).drop(gone_digest, keep_id)
    gone = stored(rest.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct(), "gone")
    return rows.join(small(gone), column(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_digest)), "left_anti").drop(digest)
