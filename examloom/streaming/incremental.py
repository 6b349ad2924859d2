"""Arriving records: first-wins deduplication and decontamination over a stream. An extension; batch jobs do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_records(stream: DataFrame, key: str, event_time: str, late: str = "1 day") -> DataFrame:
    """The first record of each key, remembered as long as it may repeat; state is bounded by the watermark."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, event_time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time window; rows later than allowed are dropped by the watermark."""
    d = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return d.groupBy(F.window(event_time, window).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def decontaminate_into(stream: DataFrame, blocked: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append records to a table unless their key is blocked or written before. Blocked keys are joined, not collected."""

    def batch(df: DataFrame, _: int) -> None:
        from examloom.sources.sinks import append_results

        clean = df.join(blocked.select(key), key, "left_anti").dropDuplicates([key])
        append_results(clean, target, key)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
