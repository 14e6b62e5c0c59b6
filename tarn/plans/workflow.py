"""One turn of an agent's run as a plan: evidence scored and kept, tools ranked, and a context under a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.python_tier import actionability, tool_payload
from tarn.functions.text import tokens
from tarn.operators import agent, library, relational

KEPT, TOOLS = 8, 7


@dataclass
class Turn:
    artifacts: DataFrame
    tools: DataFrame
    context: DataFrame


def scored(artifacts: DataFrame, half_life: float = 3600.0) -> DataFrame:
    """Artifacts (run_id, place, summary, query, age, result) with their four scores and the composite of them.

    An artifact is compared with the earlier ones of its run, of which ``last_n`` holds a run to a fixed number before.
    """
    own = tokens(F.coalesce("summary", F.lit("")))
    known = artifacts.withColumn("_own", own)
    earlier = known.select("run_id", F.col("place").alias("_before"), F.col("_own").alias("_theirs"))
    pairs = known.select("run_id", "place", "_own").join(earlier, "run_id").where("_before < place")
    before = pairs.groupBy("run_id", "place").agg(F.collect_list("_theirs").alias("_earlier"))
    rows = known.join(before, ["run_id", "place"], "left").withColumn("_earlier", F.coalesce("_earlier", F.array().cast("array<array<string>>")))
    parts = {
        "relevance": agent.relevance(F.col("_own"), tokens(F.col("query"))),
        "freshness": agent.freshness(F.col("age"), half_life),
        "uniqueness": agent.uniqueness(F.col("_own"), F.col("_earlier")),
        "actionability": actionability(tool_payload(F.col("result"))),
    }
    rows = rows.withColumns({k: F.round(v, 4) for k, v in parts.items()})
    return rows.withColumn("composite", agent.composite(*[F.col(k) for k in parts])).drop("_own", "_earlier")


def turn(artifacts: DataFrame, tools: DataFrame, query: str, remote: DataFrame | None = None, allow=(), deny=(), kept: int = KEPT, most_artifacts: int = 80) -> Turn:
    """The best artifacts of each run, the tools (name, server, text) that may be used in order of their score, and the artifacts as text.

    ``remote`` (name, score) is a tool index's answer; without one the tools are ranked by their words.
    """
    recent = relational.last_n(artifacts, "run_id", [F.col("place").desc()], most_artifacts)
    best = agent.keep_best(scored(recent), "run_id", "composite", "place", kept)
    allowed = relational.keep_allowed(relational.qualified_names(tools), "name", allow, deny)
    if remote is not None:
        ranked = allowed.join(F.broadcast(remote.select("name", "score")), "name")
    else:
        ranked = allowed.withColumn("score", agent.catalog_score(tokens(F.col("text")), tokens(F.lit(query)), F.col("text"), F.lit(query)))
    top = ranked.orderBy(F.col("score").desc(), "qualified").limit(TOOLS)
    listed = best.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("composite")).alias("_s"), "place", F.coalesce("tool", F.lit("")).alias("tool"), F.col("composite").alias("score"), "summary"))).alias("a"))
    return Turn(best, top, listed.select("run_id", library.formatted_artifacts(F.col("a"), kept).alias("text")))
