"""Context: neighbours of seeds, folds under a budget, packing, and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_BUDGET = 2000
FRAGMENT_TOKENS = 80
HISTORY_MESSAGES = 6


def linked(chunks: DataFrame, doc: Sequence[str], order: str, chunk: str) -> DataFrame:
    """Each chunk with the ids of the one before and the one behind, its ordinal from 0, and its document's total."""
    w = Window.partitionBy(*doc).orderBy(order)
    return chunks.withColumns(
        {
            "prev_id": F.lag(chunk).over(w),
            "next_id": F.lead(chunk).over(w),
            "ordinal": F.row_number().over(w) - 1,
            "total": F.count("*").over(Window.partitionBy(*doc)),
        }
    )


def budget_fill(items: Column, budget: int, most: int | None = None) -> Column:
    """From an ordered array of structs with ``n``: those taken under the budget. One that does not fit is passed over, later smaller ones still go in."""
    kind = "array<int>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("taken"))

    def step(state: Column, at: Column) -> Column:
        n = F.get(items, at)["n"].cast("long")
        fits = state["used"] + n <= budget
        if most is not None:
            fits = fits & (F.size(state["taken"]) < most)
        return F.struct(F.when(fits, state["used"] + n).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["taken"], at)).otherwise(state["taken"]).alias("taken"))

    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast(kind))
    taken = F.aggregate(places, start, step)["taken"]
    return F.transform(taken, lambda at: F.get(items, at))


def bounded_history(messages: DataFrame, key: str, order: str, size: Column, budget: int = CONTEXT_BUDGET, most: int = HISTORY_MESSAGES) -> DataFrame:
    """(key, places): the newest messages that fit, newest first while filling, oldest first in the result.

    One that does not fit is passed over, so how far back the fill reaches is not known before: the sizes and places
    (not the texts) of all of a conversation's messages are gathered in a row.
    """
    recent = messages.select(key, F.col(order).alias("place"), size.alias("n")).withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.col("place").desc())))
    arrays = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_back", "place", "n"))).alias("items"))
    kept = budget_fill(F.col("items"), budget, most)
    return arrays.select(key, F.reverse(F.transform(kept, lambda x: x["place"])).alias("places"))


def packed(items: Column, most: int, budget: int) -> Column:
    """The batch number of each item of an ordered array of structs with ``n``: a batch closes when its count or total would be exceeded."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = x["n"].cast("long")
        close = (s["count"] > 0) & ((s["count"] >= most) | (s["used"] + n > budget))
        batch = F.when(close, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(batch.alias("batch"), F.when(close, F.lit(1)).otherwise(s["count"] + 1).alias("count"), F.when(close, n).otherwise(s["used"] + n).alias("used"), F.array_append(s["out"], batch).alias("out"))

    return F.aggregate(items, start, step)["out"]


def with_neighbours(seeds: DataFrame, chunks: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Seeds (doc_id, prev_id, next_id) with the texts beside them, from the index or else from the skipped chunks."""
    every = chunks.select("doc_id", "chunk_id", "text")
    if skipped is not None:
        every = every.unionByName(skipped.select("doc_id", "chunk_id", "text").join(every, ["doc_id", "chunk_id"], "left_anti"))
    side = lambda name: every.select("doc_id", F.col("chunk_id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"))
    return seeds.join(side("prev"), ["doc_id", "prev_id"], "left").join(side("next"), ["doc_id", "next_id"], "left")


def references(hits: DataFrame, note: str, chunk: str, score: str, place: str) -> DataFrame:
    """A row a note in first-seen order: its chunks each once, its best score, and how many matched."""
    return hits.groupBy(note).agg(
        F.min(place).alias("first_seen"),
        F.max(score).alias("best"),
        F.count("*").alias("matches"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(place, chunk))), lambda x: x[chunk])).alias("chunks"),
    )


def attach_summaries() -> Column:
    """A condition over (documents, first_seed_tokens): several documents, or a first seed that is a fragment."""
    return (F.col("documents") > 1) | (F.col("first_seed_tokens") < FRAGMENT_TOKENS)
