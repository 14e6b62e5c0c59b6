"""Retrieval: searches of several sources, fusion, reranking, and a context under a budget, as one plan over an index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.dates import asked_range
from tarn.functions.text import invented_numbers
from tarn.operators import context, fusion, library, reconcile, relational
from tarn.providers import Offline

KEY = ("doc_id", "chunk_id")
#: Hits that a search over chunks, and over summaries or questions, gives.
CHUNK_HITS, ARTIFACT_HITS = 50, 10
MOST_SUMMARIES, SUMMARY_TOKENS = 3, 500
#: Weights of the searches over chunks.
WEIGHTS = {"dense": 1.0, "sparse": 0.9, "hyde": 0.8, "filtered_dense": 0.8, "filtered_sparse": 0.7}


@dataclass
class Retrieval:
    hits: DataFrame
    context: DataFrame
    references: DataFrame
    errors: dict[str, str]
    summaries: DataFrame | None = None


def postings(chunks: DataFrame, provider: Offline) -> DataFrame:
    """(key, term, weight) of chunks: an inverted list by explosion, as the sparse search reads it."""
    return chunks.select("key", F.explode(provider.sparse(F.col("embed_text"))).alias("term", "weight"))


def expanded(spark, question: str, draft: str | None) -> str | None:
    """A drafted answer that may widen the search, unless it brings numbers that the question lacks."""
    if not draft:
        return None
    invented = spark.range(1).select(F.size(invented_numbers(F.lit(draft), F.lit(question))).alias("n")).first()["n"]
    return draft if not invented else None


def date_scope(spark, question: str, base: Column, zone: str, dates: DataFrame, documents: DataFrame) -> DataFrame | None:
    """The identities of what is dated within the time that a question asks for, or None if it asks for none.

    ``base`` is when it is asked (UTC), ``zone`` its user's; ``dates`` and ``documents`` are as ``reconcile.date_identities`` takes them.
    """
    asked = spark.range(1).select(asked_range(F.lit(question), base, zone).alias("d")).first()["d"]
    return None if asked is None else reconcile.date_identities(dates, documents, F.lit(asked["start"]), F.lit(asked["end"]))


def searches(
    chunks: DataFrame, terms: Mapping[str, float], vector: Sequence[float], prefix: str = "", narrowed: DataFrame | None = None, provider: Offline | None = None, documents: int = 0
) -> dict:
    """Dense and sparse searches over chunks with ``key``, of the documents in ``narrowed`` (doc_id) if that is given."""
    rows = chunks if narrowed is None else chunks.join(F.broadcast(narrowed), "doc_id", "left_semi")
    sparse = lambda: fusion.sparse_scores(postings(rows, provider or Offline()), terms, documents, "key").orderBy(F.col("score").desc(), "key").limit(CHUNK_HITS)
    return {f"{prefix}dense": lambda: fusion.cosine_top_k(rows, vector, CHUNK_HITS, "key"), f"{prefix}sparse": sparse}


def retrieve(
    index: DataFrame, question: str, vector: Sequence[float], documents: DataFrame | None = None, top: int = 30, seeds: int = 2, budget: int = context.CONTEXT_BUDGET, threshold: float = 0.0,
    provider: Offline | None = None, summaries: DataFrame | None = None, questions: DataFrame | None = None, identities: DataFrame | None = None, hyde_vector: Sequence[float] | None = None, draft: str | None = None,
) -> Retrieval:
    """``index`` has doc_id, chunk_id, chunk_index, prev_id, next_id, embed_text, tokens, embedding, skip_reason.

    Chunks are searched by their vectors, by their terms, and by the vector of a drafted answer (``hyde_vector``, or that
    of a ``draft`` that brings no numbers of its own). The
    documents of the nearest ``summaries`` and ``questions`` (doc_id, embedding; summaries also content) are searched
    once more by themselves. ``identities`` (doc_id, chunk_id or ``*``) holds chunks to those of a time; without any,
    no chunk is found. ``documents`` (doc_id) narrows all searches; an empty one finds nothing. A source that fails
    leaves the others. Seeds are the first fused and reranked chunks; the first one's neighbours join it if it is a
    fragment; what exceeds the budget is passed over. Summaries come along for seeds of several documents and for fragments.
    """
    provider = provider or Offline()
    spark = index.sparkSession
    rows = index.where("skip_reason = ''")
    if documents is not None:
        rows = rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    if identities is not None:
        rows = relational.by_identity(rows, identities)
    keyed = rows.withColumn("key", F.struct(*KEY))
    terms = spark.range(1).select(provider.sparse(F.lit(question)).alias("t")).first()["t"] or {}
    indexed = index.count()
    wanted = searches(keyed, terms, vector, provider=provider, documents=indexed)
    if hyde_vector is None and (kept_draft := expanded(spark, question, draft)) is not None:
        hyde_vector = spark.range(1).select(provider.embed(F.lit(kept_draft)).alias("v")).first()["v"]
    if hyde_vector is not None:
        wanted["hyde"] = lambda: fusion.cosine_top_k(keyed, hyde_vector, CHUNK_HITS, "key")
    near = {name: (lambda t=t: fusion.cosine_top_k(t if documents is None else t.join(documents.select("doc_id").distinct(), "doc_id", "left_semi"), vector, ARTIFACT_HITS, "doc_id")) for name, t in (("summary", summaries), ("question", questions)) if t is not None}
    scopes, scope_errors = fusion.multi_source(near, ["doc_id"])
    if scopes is not None:
        narrowed = scopes.select("doc_id").distinct()
        if not narrowed.isEmpty():
            wanted |= searches(keyed, terms, vector, "filtered_", narrowed, provider, indexed)
    found, errors = fusion.multi_source(wanted, ["key"])
    errors = scope_errors | errors
    if found is None:
        found = spark.createDataFrame([], keyed.select(F.lit("").alias("source"), "key", F.lit(0).alias("rank")).schema)
    fused = fusion.rank_fused(found, ["key"], WEIGHTS, top=top)
    scored = keyed.join(fused.select("key"), "key", "left_semi").select("key", provider.rerank(F.lit(question), F.col("embed_text")).alias("rerank"))
    hits = fusion.reranked(fused, scored, ["key"], threshold, top)
    best = hits.limit(seeds).withColumn("place", F.monotonically_increasing_id()).join(keyed.drop("doc_id", "chunk_id"), "key").select("key.*", "place", "rrf", "chunk_index", "prev_id", "next_id", "tokens", F.col("embed_text").alias("text"))
    first = best.groupBy().agg(F.min("place").alias("p"))
    lone = best.join(F.broadcast(first), F.col("place") == F.col("p")).where(F.col("tokens") < context.FRAGMENT_TOKENS)
    around = lone.select("doc_id", F.explode(F.array("prev_id", "next_id")).alias("chunk_id"), F.lit(1 << 40).alias("place")).where("chunk_id IS NOT NULL")
    extra = around.join(index.select("doc_id", "chunk_id", "chunk_index", "tokens", F.col("embed_text").alias("text")), list(KEY))
    pool = best.select(*KEY, "place", "chunk_index", "tokens", "text", F.lit(True).alias("is_seed")).unionByName(extra.withColumn("is_seed", F.lit(False)))
    items = pool.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", *KEY, "chunk_index", F.col("tokens").alias("n"), "text", "is_seed"))).alias("items"))
    kept = items.select(F.explode(context.budget_fill(F.col("items"), budget)).alias("x")).select("x.*")
    order = kept.groupBy("doc_id").agg(F.min("place").alias("first_seen"))
    ordered = kept.join(order, "doc_id").orderBy("first_seen", "doc_id", "chunk_index").select(*KEY, "chunk_index", "text", "is_seed")
    refs = context.references(best, "doc_id", "chunk_id", "rrf", "place")
    told = None
    if summaries is not None:
        # Both numbers are of at most ``seeds`` rows; the condition is in the plan, not a job of its own.
        state = best.groupBy().agg(F.count_distinct("doc_id").alias("documents"), F.min_by("tokens", "place").alias("first_seed_tokens")).where(context.attach_summaries())
        of_seeds = library.summaries_of(summaries.select("doc_id", "content"), best, "doc_id", "place", MOST_SUMMARIES)
        told = of_seeds.where(provider.count_tokens(F.col("content")) <= SUMMARY_TOKENS).join(F.broadcast(state), F.lit(True)).select("doc_id", F.concat(F.lit("Document summary:\n"), F.col("content")).alias("text"))
    return Retrieval(hits, ordered, refs, errors, told)
