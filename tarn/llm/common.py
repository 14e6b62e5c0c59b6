"""Shared folder, table reading and small column helpers of the subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: White space of the contracts: the space and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: ContextVar[str | None] = ContextVar("tarn scratch folder", default=None)


def shared_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the folder of ``scratch``, or (``keep``, or outside one) below ``spark.checkpoint.dir``.

    Where that is unset, and all runs on one machine (tests), a temporary folder is set; on a cluster that is an error.
    """
    if not keep and _SCRATCH.get():
        return f"{_SCRATCH.get()}/{name}-{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            base = at.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="tarn-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go when it ends, but for those that are kept. What is still to be run after it must not read them."""
    path = shared_folder(spark, "scratch")
    before = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        remove(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def hot_keys(df: DataFrame, on: list[str], count: str | None = None, floor: int = 64) -> DataFrame | None:
    """The keys whose rows exceed an even share of a shuffle partition, with the number of ``salts`` that splits them into such shares.

    There are at most as many of them as shuffle partitions, so they are fetched and may be broadcast. ``df`` has one
    row a key with its ``count``, or is counted here.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = df.select(*on, F.col(count).cast("long").alias("_rows")) if count else df.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = (sized.agg(F.sum("_rows")).first()[0] or 0) if count else df.count()
    found = sized.where(F.col("_rows") > max(floor, total / parts)).collect()
    if not found:
        return None
    schema = df.select(*on).schema.add("salts", IntegerType())
    return spark.createDataFrame([(*(r[c] for c in on), math.ceil(r["_rows"] * parts / total)) for r in found], schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left), the left rows of ``hot`` keys dealt to several tasks and the right ones repeated for each.

    A row's task follows from a hash of its columns ``by``, so that a repeated attempt deals it to the same one.
    """
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("salts")).cast("int"))
    dealt = left.join(hot, on, "left").withColumn("_salt", salt).drop("salts")
    again = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(again, [*on, "_salt"], how).drop("_salt")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of very long texts fits a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
