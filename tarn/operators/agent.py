"""Scores of agent evidence and tools, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import jaccard
from tarn.llm.common import written

WEIGHTS = {"relevance": 0.4, "freshness": 0.2, "uniqueness": 0.2, "actionability": 0.2}


def relevance(summary_tokens: Column, query_tokens: Column) -> Column:
    """The share of the query's words that the summary has; 0.5 without a query, 0 without a summary."""
    return F.when(F.size(query_tokens) == 0, F.lit(0.5)).otherwise(F.size(F.array_intersect(query_tokens, summary_tokens)) / F.size(query_tokens))


def freshness(age_seconds: Column, scale: float) -> Column:
    return F.exp(-F.greatest(age_seconds, F.lit(0.0)) / scale) if scale > 0 else F.lit(1.0)


def uniqueness(own: Column, earlier: Column) -> Column:
    """1 less the highest Jaccard likeness to an earlier artifact's words; 1 without earlier ones, 0.5 without own words."""
    best = F.array_max(F.transform(F.filter(earlier, lambda t: F.size(t) > 0), lambda t: jaccard(own, t)))
    return F.when(F.size(earlier) == 0, F.lit(1.0)).when(F.size(own) == 0, F.lit(0.5)).otherwise(1 - F.coalesce(best, F.lit(0.0)))


def uniqueness_of(turns: DataFrame, key: str, order: str, own: str) -> DataFrame:
    """(key, order, uniqueness): ``uniqueness`` of each turn's words ``own`` against all earlier turns of its key, in which not all pairs meet.

    First each turn meets, for each of its words, the latest earlier turn that has it; the best likeness of these is a
    bound. A turn that is more like it than the bound shares one of its rarest words, as many as the bound leaves open,
    so only turns that share one of those are compared, if their sizes allow more than the bound. ``key`` and ``order``
    name a turn; words are gathered for one turn at a time, and a null list has none.
    """
    rows = turns.select(key, order, F.array_distinct(F.coalesce(own, F.array().cast("array<string>"))).alias("_own"))
    first = Window.partitionBy(key).orderBy(order)
    held = rows.select(key, order, F.size("_own").alias("_n"), F.explode("_own").alias("_word"))
    by_word = Window.partitionBy(key, "_word").orderBy(order)
    held = held.withColumn("_before", F.lag(order).over(by_word)).withColumn("_df", F.count("*").over(Window.partitionBy(key, "_word")))
    # Words that no other turn has are counted in _n alone. What remains is read three times, so it is written once.
    held = written(held.where("_df > 1").select(key, order, "_n", "_word", "_before", "_df"), "uniqueness-words", keep=True)

    def likest(pairs: DataFrame) -> DataFrame:
        """The best likeness of each turn among the pairs (turn, ``_other``)."""
        other = rows.select(key, F.col(order).alias("_other"), F.col("_own").alias("_others"))
        met = pairs.join(rows, [key, order]).join(other, [key, "_other"])
        return met.groupBy(key, order).agg(F.max(jaccard(F.col("_own"), F.col("_others"))).alias("_best"))

    bound = likest(held.where(F.col("_before").isNotNull()).select(key, order, F.col("_before").alias("_other")).distinct())
    rarest = Window.partitionBy(key, order).orderBy("_df", "_word")
    # A word at place i of n, rarest first, can be the first shared one of a likeness L only if i <= n - L * n + 1.
    # The words that no other turn has are the rarest of all; they come before the ones held here and need no row.
    alone = F.col("_n") - F.count("*").over(Window.partitionBy(key, order))
    ranked = held.join(bound, [key, order]).withColumn("_place", F.row_number().over(rarest) + alone)
    prefix = ranked.where(F.col("_place") <= F.col("_n") - F.ceil(F.col("_best") * F.col("_n") - 1e-9) + 1).select(key, order, "_word", "_n", "_best")
    every = held.select(key, "_word", F.col(order).alias("_other"), F.col("_n").alias("_m"))
    sizes = (F.least("_n", "_m") > F.col("_best") * F.greatest("_n", "_m"))
    closer = prefix.join(every, [key, "_word"]).where((F.col("_other") < F.col(order)) & sizes).select(key, order, "_other").distinct()
    best = bound.unionByName(likest(closer)).groupBy(key, order).agg(F.max("_best").alias("_best"))
    placed = rows.select(key, order, (F.size("_own") == 0).alias("_empty"), (F.row_number().over(first) == 1).alias("_first"))
    value = F.when(F.col("_first"), F.lit(1.0)).when(F.col("_empty"), F.lit(0.5)).otherwise(1 - F.coalesce("_best", F.lit(0.0)))
    return placed.join(best, [key, order], "left").select(key, order, value.alias("uniqueness"))


def composite(relevance_: Column, freshness_: Column, uniqueness_: Column, actionability_: Column) -> Column:
    return F.round(WEIGHTS["relevance"] * relevance_ + WEIGHTS["freshness"] * freshness_ + WEIGHTS["uniqueness"] * uniqueness_ + WEIGHTS["actionability"] * actionability_, 4)


def tool_overlap(tool_tokens: Column, query_tokens: Column) -> Column:
    """Shared words over the root of the tool's words plus one, at most 1."""
    return F.least(F.size(F.array_intersect(tool_tokens, query_tokens)) / F.sqrt(F.size(tool_tokens) + F.lit(1.0)), F.lit(1.0))


def catalog_score(tool_tokens: Column, query_tokens: Column, text: Column, phrase: Column) -> Column:
    """Coverage of the query, density in the tool's words, and a bonus for the whole phrase."""
    both = F.size(F.array_intersect(tool_tokens, query_tokens))
    coverage = F.when(F.size(query_tokens) > 0, both / F.size(query_tokens)).otherwise(F.lit(0.0))
    density = F.when(F.size(tool_tokens) > 0, both / F.sqrt(F.size(tool_tokens).cast("double"))).otherwise(F.lit(0.0))
    return coverage + density + F.when(F.contains(F.lower(text), F.lower(phrase)), F.lit(0.5)).otherwise(F.lit(0.0))


def keep_best(artifacts: DataFrame, key: str, score: str, order: str, n: int) -> DataFrame:
    """The n best artifacts of each key, ties to the earlier; ``order`` tells their original order."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(order))
    return artifacts.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
