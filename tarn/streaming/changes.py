"""Change streams: upserts and deletes in any order, with duplicates, applied to a table by version."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table, of which a batch rewrites those that it touches.
BUCKETS = 64
#: When a key that the table keeps as a tombstone was deleted; and how long tombstones are kept.
TOMBSTONE = "_deleted_at"
KEEP = "7 days"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest(changes: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """Of each key the change of the highest version, ties by ``tie``; a streaming aggregation keeps one row of state a key."""
    columns = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, tie)).alias("_row")).select(key, "_row.*")


def apply_changes(current: DataFrame, changes: DataFrame, key: str, version: str, action: str = "action") -> DataFrame:
    """``current`` after the changes: those that are not newer than the stored version are passed over, deletes remove, upserts replace."""
    best = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), version).alias("_c"))
    joined = current.select(key, F.struct(*[c for c in current.columns if c != key]).alias("_o")).join(best, key, "full")
    newer = F.col("_c").isNotNull() & (F.col("_o").isNull() | (F.col(f"_c.{version}") > F.col(f"_o.{version}")))
    alive = joined.where(F.when(newer, F.col(f"_c.{action}") != "delete").otherwise(F.col("_o").isNotNull()))
    return alive.select(key, *[F.when(newer, F.col(f"_c.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in current.columns if c != key])


def apply_with_tombstones(current: DataFrame, changes: DataFrame, key: str, version: str, at: Column, keep: str, action: str = "action") -> DataFrame:
    """``apply_changes`` on a table in which a deleted key stays as a tombstone: its version, and in ``TOMBSTONE`` when it went.

    A tombstone holds back what is not newer, in this and later batches, and goes when it is older than ``keep`` (an
    interval, such as ``7 days``) before the latest time ``at`` of the changes. What comes later than that is taken as new.
    """
    marked = changes.withColumn(TOMBSTONE, F.when(F.col(action) == "delete", at.cast("timestamp"))).withColumn(action, F.lit("upsert"))
    bare = [F.when(F.col(TOMBSTONE).isNull(), F.col(c)).alias(c) if c not in (key, version, TOMBSTONE, action) else F.col(c) for c in marked.columns]
    after = apply_changes(current, marked.select(*bare), key, version, action)
    limit = changes.agg((F.max(at.cast("timestamp")) - F.expr(f"INTERVAL {keep}")).alias("_limit"))
    kept = after.crossJoin(F.broadcast(limit)).where(F.col(TOMBSTONE).isNull() | F.col("_limit").isNull() | (F.col(TOMBSTONE) >= F.col("_limit")))  # one row
    return kept.select(*current.columns)


def run_changes(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, action: str = "action", buckets: int = BUCKETS, at: str | None = None, keep: str = KEEP) -> None:
    """Applies a stream's batches to the table at ``path``, which lies in buckets by key.

    A batch reads and writes the buckets that it touches, as ``path/v<n>/_bucket=<k>``, and then a list of where each
    bucket is newest. A batch that is replayed writes the same again. Versions that the last two lists do not name go.

    A deleted key leaves a tombstone, so that an older upsert stays out whichever batch brings it, until the tombstone is
    older than ``keep`` by the changes' column ``at`` (by the clock where none is named) and its bucket is written again.
    """
    spark = stream.sparkSession

    def batch(changes: DataFrame, n: int) -> None:
        changes = changes.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r["_bucket"] for r in changes.select("_bucket").distinct().collect()}
        before = listed(spark, path, n - 1)
        columns = [*(c for c in changes.columns if c not in (action, "_bucket")), TOMBSTONE]
        current = _read(spark, path, {k: v for k, v in before.items() if k in touched})
        current = current if current is not None else spark.createDataFrame([], changes.withColumn(TOMBSTONE, F.lit(None).cast("timestamp")).select(*columns).schema)
        if TOMBSTONE not in current.columns:  # a table from before there were any
            current = current.withColumn(TOMBSTONE, F.lit(None).cast("timestamp"))
        time = F.current_timestamp() if at is None else F.col(at)
        after = apply_with_tombstones(current.select(*columns), changes.drop("_bucket"), key, version, time, keep, action).select(*columns)
        after.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{n}")
        full = {int(name.removeprefix("_bucket=")) for name in _names(spark, f"{path}/v{n}") if name.startswith("_bucket=")}
        now = {k: v for k, v in before.items() if k not in touched} | dict.fromkeys(full, n)
        spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_list/v{n}")
        older = listed(spark, path, n - 2)
        for k, v in older.items():
            if before.get(k) != v and now.get(k) != v:
                _delete(spark, f"{path}/v{v}/_bucket={k}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def listed(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The newest version of each bucket as of batch n or the last one before it: at most one row a bucket."""
    done = [v for name in _names(spark, f"{path}/_list") if name[:1] == "v" and (v := int(name[1:])) <= n]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/_list/v{max(done)}").collect()} if done else {}


def _read(spark: SparkSession, path: str, where: dict[int, int]) -> DataFrame | None:
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/v{v}/_bucket={k}" for k, v in sorted(where.items())]) if where else None


def snapshot(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    """The table as of batch n or the last one before it, without tombstones; the last two batches can be read."""
    rows = _read(spark, path, listed(spark, path, n))
    return rows if rows is None or TOMBSTONE not in rows.columns else rows.where(F.col(TOMBSTONE).isNull()).drop(TOMBSTONE)


def version_guard(stream: DataFrame, key: str, version: str) -> DataFrame:
    """Arrivals with ``fresh``: whether the version is above all that the key's state has seen. Keyed state without expiry, one number a key."""
    schema = stream.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", fresh boolean"

    def guard(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        for pdf in frames:
            fresh = []
            for v in pdf[version]:
                ok = seen is None or v > seen
                fresh.append(ok)
                seen = int(v) if ok else seen
            yield pdf.assign(fresh=fresh)
        if seen is not None:
            state.update((seen,))

    return stream.groupBy(key).applyInPandasWithState(guard, out, "seen long", "append", "NoTimeout")
