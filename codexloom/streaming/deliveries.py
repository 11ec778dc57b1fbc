"""Incremental forms: deliveries without repeats, windowed counts, and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codexloom.operators.asknown import PERIOD_DAYS, change_log


def once(stream: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once, however often it is delivered within ``late`` of its first time.

    ``at`` is an event time; state for a key is dropped after the watermark passes it.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows per window and group: tumbling, or sliding with ``slide``."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return s.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Rows per session of each group; a session ends after ``gap`` without a row."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return s.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def keep_change_log(versions: DataFrame, path: str, checkpoint: str, days: int = PERIOD_DAYS) -> StreamingQuery:
    """Write the as-known change log of a stream of versions, partitioned by period.

    Each batch has its own folder, written over if the batch is repeated after a loss,
    so every version's change is there exactly once. Readers take the maximum per node
    and day, which is what batches of the same day need.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        log = change_log(batch, days)
        log.write.mode("overwrite").partitionBy("period").parquet(f"{path}/batch={epoch}")

    return versions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
