"""Log and metric aggregates over time windows, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of latency buckets, in the unit of the observed value.
BUCKETS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


def counts_by_window(events: DataFrame, ts: str, every: str, labels: Sequence[str]) -> DataFrame:
    w = F.window(F.col(ts), every)
    return events.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *labels, "n")


def percent(part: Column, whole: Column) -> Column:
    """100 * count of rows where part holds / count where whole holds; null if none does."""
    return F.when(F.count_if(whole) > 0, 100.0 * F.count_if(part) / F.count_if(whole))


def value_by_window(events: DataFrame, ts: str, every: str, value: str, labels: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Mean and 95th percentile of a field in each window; ``exact=False`` is for streams, whose percentile is approximate."""
    w = F.window(F.col(ts), every)
    p95 = F.percentile(value, 0.95) if exact else F.percentile_approx(value, 0.95)
    return events.groupBy(w.alias("w"), *labels).agg(p95.alias("p95"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), *labels, "p95", "mean")


def histogram(events: DataFrame, value: str, labels: Sequence[str], buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative bucket counts, count and sum, by labels."""
    le = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}") for b in buckets]
    return events.groupBy(*labels).agg(*le, F.count("*").alias("count"), F.sum(value).alias("sum"))


def within_retention(events: DataFrame, ts: str, now: Column, keep: str = "24 hours") -> DataFrame:
    return events.where(F.col(ts) >= now - F.expr(f"INTERVAL {keep}"))
