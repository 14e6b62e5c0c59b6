"""Queries of streams over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.queries import query, shared
from tarn.session import table
from tarn.streaming import answers, changes

_T0 = "2024-05-01 12:00:00"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of answers: a start, a delta a turn, reported usage, and an end, an error or (of every fifth) none."""
    conv = F.col("conv_id")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(order))
    ends = turns.groupBy("conv_id").agg(F.max("seq").alias("n"))
    none, at = F.lit(None).cast("long"), lambda s: F.lit(_T0).cast("timestamp") + F.make_interval(secs=s)
    row = lambda seq, kind, content, prompt, completion: [conv.cast("string").alias("message_id"), seq.cast("int").alias("seq"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), content.cast("string").alias("content"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), none.alias("total_tokens"), at(conv % 10 + seq / 4).alias("at")]
    begun = ends.select(*row(F.lit(0), "start", F.lit(None), (conv % 50).cast("long"), none))
    deltas = turns.select(*row(F.col("seq"), "delta", F.col("text"), none, none))
    usage = ends.select(*row(F.col("n") + 1, "usage", F.lit(None), none, F.when(conv % 2 == 1, F.lit(11).cast("long"))))
    closed = ends.where(conv % 5 != 0).select(*row(F.col("n") + 2, F.when(conv % 5 == 1, "error").otherwise("end"), F.when(conv % 5 == 1, "broken"), none, none))
    return begun.unionByName(deltas).unionByName(usage).unionByName(closed)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("message_id", F.sha2("text", 256).alias("text_sha256"), "status", "error", "deltas", "first_token_ms", "latency_ms", "prompt_tokens", "completion_tokens", "total_tokens")


_ANSWERS_SQL = r"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, "text" NULLS FIRST) AS seq FROM conversations),
m AS (SELECT conv_id, count(*) AS n, coalesce(string_agg("text", '' ORDER BY seq), '') AS txt, count(*) FILTER (coalesce("text", '') <> '') AS deltas, min(seq) FILTER (coalesce("text", '') <> '') AS first FROM t GROUP BY conv_id),
u AS (SELECT *, CASE WHEN conv_id % 2 = 1 THEN 11 ELSE len(list_filter(string_split_regex(txt, '[ \t\n\r\f\v]+'), lambda w: w <> '')) END AS completion FROM m)
SELECT CAST(conv_id AS VARCHAR) AS message_id, sha256(txt) AS text_sha256, CASE conv_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN conv_id % 5 = 1 THEN 'broken' END AS error,
  deltas, CAST(floor(first * 250) AS BIGINT) AS first_token_ms, CAST(floor((n + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 2 END) * 250) AS BIGINT) AS latency_ms, conv_id % 50 AS prompt_tokens, completion AS completion_tokens, conv_id % 50 + completion AS total_tokens FROM u"""


@query(_ANSWERS_SQL)
def answers_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(answers.answers(_items(spark, sf_dir)))


@query(_ANSWERS_SQL)
def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state and timers; later items of another message move the watermark, so that silent ones are closed."""
    folder = shared(spark, "answers")
    _items(spark, sf_dir).write.parquet(f"{folder}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, answers.ROCKSDB)
    try:
        stream = answers.answer_stream(spark.readStream.schema(answers.ITEM).parquet(f"{folder}/in"), 60)
        for hours in (None, 24, 25):
            if hours:
                clock = f"SELECT 'clock' AS message_id, {hours} AS seq, 'delta' AS kind, 'x' AS content, CAST(NULL AS BIGINT) AS prompt_tokens, CAST(NULL AS BIGINT) AS completion_tokens, CAST(NULL AS BIGINT) AS total_tokens, TIMESTAMP '{_T0}' + INTERVAL {hours} HOUR AS at"
                spark.sql(clock).write.mode("append").parquet(f"{folder}/in")
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return _shown(spark.read.schema(answers.ANSWER).parquet(f"{folder}/out").where("message_id <> 'clock'"))


@query("""WITH c AS (SELECT o_custkey AS id, o_orderkey AS version, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS action, o_orderpriority AS "text" FROM orders),
n AS (SELECT id, max(version) AS version, arg_max(action, version) AS action, arg_max("text", version) AS "text" FROM c GROUP BY id) SELECT id, version, "text" FROM n WHERE action = 'upsert'""")
def changes_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as upserts and deletes of their customers, the newer ones in the earlier batches: tombstones hold the older ones back."""
    folder = shared(spark, "changes")
    status = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), status.alias("action"), F.col("o_orderpriority").alias("text"), F.lit(_T0).cast("timestamp").alias("at"))
    cut = rows.agg(F.percentile_approx("version", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c")).first()["c"]
    for part in (F.col("version") > cut[1], (F.col("version") > cut[0]) & (F.col("version") <= cut[1]), F.col("version") <= cut[0]):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        changes.run_changes(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", "id", "version", buckets=16, at="at")
    return changes.snapshot(spark, f"{folder}/out", 1 << 30).select("id", "version", "text")
