"""Exact deduplication by a stream whose disk-backed state never expires.

The state keeps, for each digest of a normalised text, the stable identifier and the content locator (file and row in
the store) of the row that stays, and how many rows have come. Each row that hits a digest is compared with the row
behind the locator by its full bytes before it counts as a copy. A store outlives the call: what arrives later is met
with the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import SPACE_RUN, hot_keys, salted_join, scratch, shared_folder, written

#: A stream reads at most so much in one micro-batch.
BYTES_PER_BATCH = 64 << 30
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def rocksdb_state(spark: SparkSession):
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Else each of many small stores holds megabytes of preallocated files.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        # One bound for all stores of an executor; each store's buffers are taken in eighths of the buffer size.
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(rows: DataFrame) -> DataFrame:
    """Rows of the store with their locator: the name of the file, which is never written again, and the row in it."""
    return rows.withColumn("locator", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


def first_of_digest(arrivals: DataFrame) -> DataFrame:
    """A streaming (or batch) aggregation over (digest, n_bytes, doc_id, locator): the smallest doc_id (null last) with its locator, and the count."""
    return arrivals.groupBy("digest", "n_bytes").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"),
        F.count("*").alias("group_size"),
    )


def run_state(spark: SparkSession, landed: str, schema, checkpoint: str, bytes_per_batch: int = BYTES_PER_BATCH) -> None:
    """Feeds what is new in ``landed`` into the state at ``checkpoint``; a later call with more files carries on from there."""
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(landed)
    with rocksdb_state(spark):
        query = (
            first_of_digest(located(stream).select("digest", "n_bytes", "doc_id", "locator"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as rows of (digest, n_bytes, keep_id, keep_locator, group_size)."""
    with rocksdb_state(spark):
        state = spark.read.format("statestore").load(checkpoint)
    first, size = (F.col(f"value.`{n}`") for n in state.schema["value"].dataType.fieldNames())
    return state.select("key.digest", "key.n_bytes", first["doc_id"].alias("keep_id"), first["locator"].alias("keep_locator"), size.alias("group_size"))


def mark_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, key: str = "doc_id", text: str = "text", store: str | None = None) -> DataFrame:
    """Rows with what was decided: a struct ``row`` of the original columns, doc_id, keep_id, group_size, kept, digest.

    Of rows with equal normalised texts the one with the smallest doc_id stays (null ids come last; of rows that
    repeat that id, one). Null texts count as empty and are copies of each other. ``digest`` may be weak: rows
    that share a digest but not the bytes are grouped by their bytes. Columns may have any names; texts any length.

    ``docs`` is added to the ``store``, a folder that all executors reach (by default a new one), and the rows of all
    that the store holds come back; the stream reads only what is new in it. Calls on one store must have the same
    columns, key, text and digest.
    """
    spark = docs.sparkSession
    store = store or shared_folder(spark, "dedup")
    landed, checkpoint = f"{store}/rows", f"{store}/state"
    norm = normalised(F.col(text))
    docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("doc_id"),
        digest(norm).alias("digest"),
        F.octet_length(norm).cast("long").alias("n_bytes"),
    ).write.mode("append").option("compression", "zstd").parquet(landed)
    rows = spark.read.parquet(landed)
    run_state(spark, landed, rows.schema, checkpoint)
    rows = located(rows)
    groups = written(read_state(spark, checkpoint).where("group_size > 1"), "dedup-groups")
    hot = hot_keys(groups, ["digest", "n_bytes"], "group_size")
    unlike = unlike_rows(rows, groups, text)
    small = rows.select("row", "doc_id", "locator", "digest", "n_bytes")
    marked = salted_join(small, groups, ["digest", "n_bytes"], ["locator"], "left", hot)
    if not unlike.isEmpty():
        marked = regrouped(marked, unlike, hot)
    return marked.select(
        "row",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("locator") == F.col("keep_locator"), F.lit(True)).alias("kept"),
        "digest",
    )


def unlike_rows(rows: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """The full-bytes check: rows whose normalised text differs from that behind the locator of their digest.

    Texts meet the groups of digests once, by a sort-merge join at every size (the groups grow with the rows, so they
    are not broadcast while they happen to be few); a large group's are spread over tasks, each with the text that stays.
    """
    with scratch(rows.sparkSession):
        hit_texts = salted_join(rows.select("locator", "doc_id", "digest", "n_bytes", F.col(f"row.`{text}`").alias("text")), groups.hint("merge"), ["digest", "n_bytes"], ["locator"], hot=hot_keys(groups, ["digest", "n_bytes"], "group_size"))
        hit_texts = written(hit_texts.select("locator", "doc_id", "digest", "n_bytes", "keep_locator", normalised(F.col("text")).alias("text")), "dedup-hits")
        kept = hit_texts.where("locator = keep_locator").select("keep_locator", F.col("text").alias("kept_text"))
        copies = hit_texts.where("locator <> keep_locator")
        met = salted_join(copies, kept, ["keep_locator"], ["locator"], hot=hot_keys(groups, ["keep_locator"], "group_size"))
        return written(met.where("text <> kept_text").select("locator", "doc_id", "digest", "n_bytes", "text"), "dedup-unlike", keep=True)


def regrouped(marked: DataFrame, unlike: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows that only share a digest get groups by their bytes, and leave the size of the group that they were in."""
    own = unlike.groupBy("digest", "n_bytes", "text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"), F.count("*").alias("own_size"))
    moved = unlike.join(own, ["digest", "n_bytes", "text"]).select("locator", F.col("first.doc_id").alias("own_id"), F.col("first.locator").alias("own_locator"), "own_size")
    left = unlike.groupBy("digest", "n_bytes").agg(F.count("*").alias("gone"))
    out = salted_join(marked.join(moved, "locator", "left"), left, ["digest", "n_bytes"], ["locator"], "left", hot)
    is_own = F.col("own_size").isNotNull()
    return out.select(
        "row",
        "doc_id",
        "locator",
        "digest",
        "n_bytes",
        F.when(is_own, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(is_own, F.col("own_locator")).otherwise(F.col("keep_locator")).alias("keep_locator"),
        F.when(is_own, F.col("own_size")).otherwise(F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return mark_copies(docs).where("kept").select("row.*")
