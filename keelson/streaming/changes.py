"""Status changes as a stream: micro-batches applied to the bucketed table, late repeats dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelson.operators.cdc import BucketedTable, apply_changes


def apply_stream(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start applying a stream of changes to the table at ``root``. Each micro-batch commits one version; a batch that
    is repeated after a failure changes nothing, since its changes are then already in the table. Changes may come late
    and in any order; the state is always that of all changes so far."""

    def apply(batch: DataFrame, _: int) -> None:
        apply_changes(BucketedTable.load(batch.sparkSession, root), batch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_per_window(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n): events per tumbling window; works on streams and on tables alike."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
