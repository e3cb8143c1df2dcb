"""Inference over documents that arrive in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.observe import Table, counted, gathered
from ..plans.infer import Inference, settled
from ..sources.corpus import from_rows


class Incremental:
    """Observations that grow by batches; the schema is settled when asked for.

    What each batch says, as many rows as the schema has columns, is a folder of
    ``store``, a path that the cluster shares. So a restarted stream, or another
    process, goes on with all earlier batches, and a batch that is delivered again
    replaces itself. Merging is commutative: batches may come in any order.
    """

    def __init__(self, spark: SparkSession, store: str, config: dict | None = None) -> None:
        self.spark, self.store, self.config = spark, store.rstrip("/"), Config.of(config)

    def add(self, corpus: DataFrame, number: int) -> None:
        """Adds what one batch of documents says, under its number."""
        counted(corpus, self.config.maps).coalesce(1).write.mode("overwrite").parquet(f"{self.store}/batch={number}")

    def over(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts observing a stream of (doc_ord, value)."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.add(from_rows(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def inference(self) -> Inference:
        """The schema of all batches so far."""
        return settled(gathered(self.spark.read.parquet(self.store)) or {(): Table()}, self.config)
