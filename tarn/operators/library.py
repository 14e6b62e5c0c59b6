"""Small reads and writes of a note library and its index: browsing, existence, artifacts, accounting, and table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.relational import all_of, replace_documents, upsert

OLD_ID_CHARS = 73
MOST_SUMMARIES = 50


def visible(notes: DataFrame, folder: Column | None, needle: str | None, text: Sequence[str], pinned: str, updated: str, tie: str) -> DataFrame:
    """Notes of a folder (all without one) that have the needle in one of the ``text`` columns, whatever its case: pinned ones first, then the newest."""
    found = None
    if needle:
        wanted = F.lower(F.lit(needle))
        found = F.exists(F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in text]), lambda x: F.contains(x, wanted))
    return notes.where(all_of(folder, found)).orderBy(F.col(pinned).desc(), F.col(updated).desc(), F.col(tie))


def old_format_ids(documents: DataFrame, doc: str = "doc_id", chars: int = OLD_ID_CHARS) -> DataFrame:
    """Documents whose id is longer than two ids joined by a sign."""
    return documents.where(F.length(F.col(doc).cast("string")) > chars)


def with_folder(notes: DataFrame, folders: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each note with columns of its folder; one without a folder goes. Spark broadcasts the folders where they are below its threshold."""
    return notes.join(folders.select(key, *columns), key)


def tagged(notes: DataFrame, bridge: DataFrame, note: str, where: Column | None = None) -> DataFrame:
    """Notes that have a tag (of those that ``where`` takes)."""
    return notes.join(bridge if where is None else bridge.where(where), note, "left_semi")


def with_seed_scores(chunks: DataFrame, seeds: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Chunks with the score that they have as a seed, null for their neighbours, and ``is_seed``."""
    best = seeds.groupBy(*key).agg(F.max(score).alias(score))
    return chunks.join(best, list(key), "left").withColumn("is_seed", F.col(score).isNotNull())


def call_totals(calls: DataFrame, kind: str, retry: Column) -> DataFrame:
    """Per kind of request how many were made, retries apart."""
    return calls.groupBy(kind).agg(F.count_if(~retry).alias("calls"), F.count_if(retry).alias("retries"))


def skip_counts(chunks: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """By the class of the reason (what stands before its colon) the chunks that are not indexed."""
    return chunks.where(F.col(reason) != "").groupBy(F.substring_index(reason, ":", 1).alias("class")).agg(F.count("*").alias("chunks"))


def context_chunks(references: DataFrame, message: str, chunks: str = "chunks") -> DataFrame:
    """Per message the chunks that its references hold together."""
    return references.groupBy(message).agg(F.sum(F.coalesce(F.size(chunks), F.lit(0))).alias("context_chunks"))


def scroll(points: DataFrame, key: Sequence[str], limit: int, vectors: Sequence[str] = ("embedding",)) -> DataFrame:
    """The first points by key, without their vectors."""
    return points.drop(*vectors).orderBy(*key).limit(limit)


def newest_summaries(summaries: DataFrame, updated: str, tie: str, limit: int = 10) -> DataFrame:
    """Newest first; the limit is held to 1 to 50."""
    return summaries.orderBy(F.col(updated).desc(), F.col(tie)).limit(min(MOST_SUMMARIES, max(1, limit)))


def summaries_of(summaries: DataFrame, documents: DataFrame, doc: str, place: str, limit: int) -> DataFrame:
    """The summaries of the ranked ``documents``, in their order."""
    return summaries.join(documents.groupBy(doc).agg(F.min(place).alias(place)), doc).orderBy(place, doc).limit(limit)


def replaced_artifacts(tables: Mapping[str, DataFrame], document: DataFrame, artifacts: Mapping[str, DataFrame], doc: str = "doc_id", version: str = "version") -> dict[str, DataFrame]:
    """The tables after documents came: their rows in ``documents`` merged by version, and in every table of ``artifacts`` all their old rows gone and the new ones in.

    A document without new rows in a table loses its old ones there. All results derive from the tables as they
    were, so that a caller who writes them as one snapshot replaces all or nothing.
    """
    ids = document.select(doc).distinct()
    out = dict(tables)
    out["documents"] = upsert(tables["documents"], document, [doc], version)
    for name, rows in artifacts.items():
        out[name] = replace_documents(tables[name].join(ids, doc, "left_anti"), rows, doc)
    return out


def finalised(messages: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Messages with the text, status and counts of their ``results``; a result without a message is added, a complete message stays as it is."""
    columns = [c for c in results.columns if c != key]
    new = results.select(key, F.struct(*columns).alias("_new"))
    joined = messages.withColumn("_old", F.lit(True)).join(new, key, "full")
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.coalesce("status", F.lit("")) != "complete"))
    return joined.select(*[F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in messages.columns])


def dimension_checked(points: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """The points; a vector of another dimension is an error."""
    told = F.concat(F.lit(f"{vector} has "), F.size(vector).cast("string"), F.lit(f" places, not {dimension}"))
    return points.withColumn(vector, F.when(F.col(vector).isNull() | (F.size(vector) == dimension), F.col(vector)).otherwise(F.raise_error(told)))


def formatted_plan(goal: Column, steps: Column, current: Column) -> Column:
    """A plan as text: its goal and numbered steps (structs of title and action), the current one (from 0) marked."""
    line = lambda x, i: F.concat(F.when(i == current, F.lit(">> ")).otherwise(F.lit("   ")), F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x["title"], F.lit(" — "), x["action"])
    return F.concat(F.lit("Goal: "), goal, F.lit("\n"), F.array_join(F.transform(steps, line), "\n"))


def formatted_calls(calls: Column) -> Column:
    """Tool calls (structs of name, status, preview), a line each."""
    return F.array_join(F.transform(calls, lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["status"], F.lit("): "), x["preview"])), "\n")


def formatted_artifacts(artifacts: Column, most: int = 8, chars: int = 1200) -> Column:
    """The first artifacts (structs of tool, score, summary), each with its score and the start of its summary."""
    return F.array_join(F.transform(F.slice(artifacts, 1, most), lambda x: F.concat(F.lit("- ["), x["tool"], F.lit("] score="), F.format_number(x["score"], 2), F.lit("\n  "), F.substring(x["summary"], 1, chars))), "\n")


def trimmed(text: Column, chars: Column) -> Column:
    """A list of artifacts within so many characters: whole items, and a line that tells of those left out."""
    cut = F.substring(text, F.lit(1), chars)
    whole = F.when(F.contains(cut, F.lit("\n- ")), F.regexp_replace(cut, r"(?s)^(.*)\n- .*$", "$1")).otherwise(cut)
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.rtrim(whole), F.lit("\n- [truncated] more was left out")))
