"""Structured Streaming: incremental scoring with an idempotent sink, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and keys; events later than `late` behind the newest are dropped.
    Watermarks need instants, so times without a zone are read in the session's and given back without one."""
    kind = dict(events.dtypes)[time]
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").cast(kind).alias("start"), *keys, "n", "total")


def distinct_events(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """At-least-once input without its repeats, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def score_new(source: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Scores what the source has not given before and writes one folder a batch; a batch that runs twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(counts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes the whole result of a streaming aggregation after each batch; the last batch's rows are in the sink at the end."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
