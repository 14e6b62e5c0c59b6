"""Drift between notes and the documents that index them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def stale_notes(notes: DataFrame, documents: DataFrame, keys: list[str], limit: int | None = 200, order: list[Column] | None = None) -> DataFrame:
    """Notes without a document, or whose document has a lower version, the oldest first. ``limit`` is the batch of one run; None takes all."""
    docs = documents.select(*keys, "indexed_version")
    found = notes.join(docs, keys, "left").where(F.col("indexed_version").isNull() | (F.col("indexed_version") < F.col("version")))
    return found if limit is None else found.orderBy(*(order or [F.col(k) for k in keys])).limit(limit)


def orphans(documents: DataFrame, notes: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Documents whose note is gone or blank."""
    return documents.join(notes.where(has_text(text)).select(*keys).distinct(), keys, "left_anti")


def stale_arrivals(arrivals: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Arrivals marked stale: an upsert below the stored version or without a note, a delete only below a stored version."""
    joined = arrivals.join(stored.select(key, F.col("version").alias("stored_version")), key, "left")
    older = F.coalesce(F.col("version") < F.col("stored_version"), F.lit(False))
    return joined.withColumn("stale", F.when(F.col("action") == "delete", older).otherwise(older | F.col("stored_version").isNull()))


def date_identities(dates: DataFrame, documents: DataFrame, start, end, half_open: bool = False) -> DataFrame:
    """Chunks dated in the range, and whole documents (chunk ``*``) created or updated in it, each once. The range has both ends unless half open."""
    within = lambda c: (F.col(c) >= start) & ((F.col(c) < end) if half_open else (F.col(c) <= end))
    by_content = dates.join(documents.select("doc_id"), "doc_id", "left_semi").where(within("date_value")).select("doc_id", "chunk_id")
    by_document = documents.where(within("created_at") | within("updated_at")).select("doc_id", F.lit("*").alias("chunk_id"))
    return by_content.unionByName(by_document).distinct()
