"""Rankings: dense and sparse nearest neighbours, reciprocal rank fusion, and the rerank contract."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.vectors import cosine, literal

RRF_K = 60
#: Weights of the search sources.
WEIGHTS = {"dense": 1.0, "sparse": 0.9, "filtered": 0.8, "summary": 0.7, "question": 0.6}


def cosine_top_k(points: DataFrame, vector: Sequence[float], k: int, key: str, embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest points as (key, score), ties by key. Each task keeps k rows; points of another dimension or length zero are no neighbours."""
    rows = points if where is None else points.where(where)
    scored = rows.select(F.col(key), cosine(F.col(embedding), literal(vector)).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def sparse_scores(postings: DataFrame, query: Mapping[str, float], documents: int, key: str) -> DataFrame:
    """Sum over shared terms of query weight, document weight and idf. ``postings`` has key, term, weight."""
    terms = sorted(query)
    hits = postings.where(F.col("term").isin(*terms))
    weight = F.element_at(F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(float(query[t])))]), F.col("term"))
    idf = hits.groupBy("term").agg(F.log(1 + (documents - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    return hits.join(F.broadcast(idf), "term").groupBy(key).agg(F.sum(F.col("weight") * weight * F.col("idf")).alias("score"))


def ranked(hits: DataFrame, source: str, key: Sequence[str], score: str = "score") -> DataFrame:
    """A source's hits with their rank from 1; hits are a search's top list, so one task orders them."""
    w = Window.orderBy(F.col(score).desc(), *[F.col(k) for k in key])
    return hits.select(F.lit(source).alias("source"), *key, F.row_number().over(w).alias("rank"))


def rank_fused(hits: DataFrame, key: Sequence[str], weights: Mapping[str, float] = WEIGHTS, k: int = RRF_K, top: int | None = 30) -> DataFrame:
    """(key, rrf, contributions by source) of hits (source, key, rank), best first; equal scores are ordered by key.

    A key that a source lists twice counts twice, and its contribution told is that of the later place. A source without a weight has weight 1.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]), F.col("source")), F.lit(1.0))
    parts = hits.withColumn("part", weight / (k + F.col("rank"))).groupBy(*key, "source").agg(F.sum("part").alias("part"), F.max_by("part", "rank").alias("last"))
    fused = parts.groupBy(*key).agg(F.sum("part").alias("rrf"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "last")))).alias("contributions"))
    ordered = fused.orderBy(F.col("rrf").desc(), *[F.col(c) for c in key])
    return ordered if top is None else ordered.limit(top)


def reranked(hits: DataFrame, scores: DataFrame | None, key: Sequence[str], threshold: float, top: int) -> DataFrame:
    """Hits by the reranker's score at or above the threshold; without scores, or if none passes, in the order of fusion."""
    by_fusion = hits.orderBy(F.col("rrf").desc(), *[F.col(c) for c in key]).limit(top)
    if scores is None:
        return by_fusion
    kept = hits.join(scores.select(*key, "rerank"), list(key)).where(F.col("rerank") >= threshold).orderBy(F.col("rerank").desc(), *[F.col(c) for c in key]).limit(top)
    return by_fusion if kept.isEmpty() else kept.drop("rerank")


def multi_source(searches: Mapping[str, Callable[[], DataFrame]], key: Sequence[str], most: int = 1000) -> tuple[DataFrame | None, dict[str, str]]:
    """The ranked union of the searches, and the error of each that could not be planned or run; such a source is empty.

    Each search is a top list, of which at most ``most`` rows are fetched, so that one that fails does so alone.
    """
    parts, errors = [], {}
    for source, search in searches.items():
        try:
            hits = ranked(search().limit(most), source, key)
            parts.append(hits.sparkSession.createDataFrame(hits.collect(), hits.schema))
        except Exception as e:  # one source's failure leaves the others
            errors[source] = f"{type(e).__name__}: {e}"
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out, errors
