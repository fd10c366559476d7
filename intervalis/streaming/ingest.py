"""Streams into collections: late and repeated records go to their place whenever they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import keys as K
from ..operators import mutations


def upsert_stream(stream: DataFrame, collection, checkpoint: str, order: str | None = None, replace_keys: bool = True) -> DataStreamWriter:
    """Upserts each micro-batch; of equal keys in a batch the last by ``order`` counts. A repeated batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        collection.batch_upsert(mutations.last_of_each(batch, collection.key_type, order) if order else batch, replace_keys)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def completed(events: DataFrame, end_marker: str) -> DataFrame:
    """Pairs of start and end events as keys: a start without a later end of the same id is still active."""
    later = Window.partitionBy(K.ID).orderBy("time")
    spans = events.withColumn("_next", F.lead(F.struct("time", "kind")).over(later)).where(F.col("kind") != end_marker)
    ended = F.col("_next.kind") == end_marker
    return spans.withColumns({K.START: F.col("time"), K.END: F.when(ended, F.col("_next.time")), K.ACTIVE: ~F.coalesce(ended, F.lit(False))}).drop("_next", "time", "kind")
