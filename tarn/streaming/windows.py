"""Windowed counts and delta accumulation over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, ts: str, every: str, labels: list[str], late: str | None = None) -> DataFrame:
    """Counts in tumbling windows; ``late`` sets how long a window waits for rows that come late. Zone-less times are taken as UTC."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        timed = timed.withWatermark(ts, late)
    w = F.window(ts, every)
    return timed.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *labels, "n")


def closed_counts(events: DataFrame, ts: str, every: str, labels: list[str], late: str) -> DataFrame:
    """Counts of windows that can get no more rows, for append mode: the state holds the open windows alone, and each is written once."""
    return window_counts(events, ts, every, labels, late)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Runs what is available; in complete mode each batch overwrites ``path`` by its whole result, in append mode it adds to it."""
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulated(deltas: DataFrame, message: str, order: str, delta: str, ts: str) -> DataFrame:
    """A message's text joined in order, its first-token time, and the number of deltas. Partial messages give what has come."""
    return deltas.groupBy(message).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, delta))), lambda x: x[delta]), "").alias("text"),
        F.min(ts).alias("first_at"),
        F.count("*").alias("deltas"),
    )
