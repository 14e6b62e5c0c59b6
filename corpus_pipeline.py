"""A corpus pipeline over ``documents``: toxic documents go, exact copies go, one of each group of near copies
stays, the rest is mixed to target weights, and what remains is encoded into sentence pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import remove, scratch, shared_folder, table, written
from tarn.llm.exact_dedup import deduplicated
from tarn.llm.mixing import domain_of, mixed_documents
from tarn.llm.ngram_groups import link_components
from tarn.llm.pieces import encode_decode
from tarn.llm.queries import piece_model
from tarn.llm.toxicity import without_toxic


ROW_NAME = "_pipeline_row"
#: Shares of the tokens that documents of quality 1 and 0 are to have.
QUALITY_WEIGHTS = {"q1": 0.94, "q0": 0.06}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier rejects go.

    Null and empty texts are scored as empty ones; null and repeated ids and repeated rows are judged by their texts.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, null ids last; null texts equal empty ones."""
    return deduplicated(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, null ids last.

    A row is known by its id and a hash of its text, so that rows that share an id are told apart. Of rows that
    repeat both, one stays. Texts without words are nobody's copies.
    """
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    name = F.concat(F.coalesce(number, F.lit("null")), F.lit(":"), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn(ROW_NAME, name)
    found = written(link_components(keyed.select(ROW_NAME, "text"), key=ROW_NAME).withColumnRenamed("doc_id", ROW_NAME), "pipeline-links")
    gone = found.where(F.col(ROW_NAME) != F.col("component_id")).select(ROW_NAME).distinct()
    kept = keyed.join(gone, ROW_NAME, "left_anti")
    again = found.where("n_shingles > 0").groupBy(ROW_NAME).agg(F.count("*").alias("rows")).where("rows > 1").select(ROW_NAME)
    if not again.isEmpty():
        kept = kept.join(again, ROW_NAME, "left_anti").unionByName(kept.join(again, ROW_NAME, "left_semi").dropDuplicates([ROW_NAME]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate asks. Toxic documents have gone, so the domains that remain are those of quality.

    Empty and null texts have a rate like others of their posterior; null ids are told apart by their texts.
    """
    return mixed_documents(docs, table(spark, sf_dir, "labels"), QUALITY_WEIGHTS, domain_of(q="quality"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with what they decode to as a digest; null texts count as empty and have an end id only."""
    return encode_decode(docs, piece_model(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("sentence_pieces", sentence_pieces),
]

#: SQL cannot express the classifier, the mixing fit and the encoding; a test holds all rows against a plain version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}", keep=True)
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
