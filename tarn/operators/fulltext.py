"""English full-text search over an inverted index: a table of terms with sorted lists of ids, in blocks.

A document's block follows from its key, so all its terms are in one block: lists meet block by block and none grows
with the table beyond about ``BLOCK_DOCS`` ids, however common its term is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.english import english_terms, terms

#: Documents of a block, about.
BLOCK_DOCS = 50_000
#: Ids that a task holds in lists before it sends them, and rows that it sends at once.
HELD_IDS, ROWS = 1_000_000, 20_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """(term, block, n, ids): for each term and block the ascending distinct ids of its documents.

    ``blocks`` has to be the same for tables that are united; by default the documents are counted. Null texts have no
    terms, and null keys cannot be found and are left out. Write it sorted by term (``write_postings``) for searches that
    read little of it.
    """
    n = blocks or max(1, math.ceil(docs.count() / BLOCK_DOCS))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "text")

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def frames() -> Iterator[pd.DataFrame]:
            found = list(held.items())
            held.clear()
            for i in range(0, len(found), ROWS):
                yield pd.DataFrame([(*k, ids) for k, ids in found[i : i + ROWS]], columns=["term", "block", "part"])

        for b in batches:
            for i, block, t in zip(b["id"].tolist(), b["block"].tolist(), b["text"], strict=True):
                for term in (found := terms(t)):
                    held.setdefault((term, block), []).append(i)
                size += len(found)
                if size > HELD_IDS:
                    yield from frames()
                    size = 0
        yield from frames()

    parts = rows.mapInPandas(lists, f"term string, block int, part array<{docs.schema[key].dataType.simpleString()}>")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("part"))))
    return parts.groupBy("term", "block").agg(ids.alias("ids")).select("term", "block", F.size("ids").alias("n"), "ids")


def write_postings(index: DataFrame, path: str) -> DataFrame:
    """The index as a table whose files are each in order of their terms, so that a search reads the row groups of its own terms only."""
    index.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


def search(index: DataFrame, query: str) -> DataFrame:
    """(id): the documents that have every term of the query; of a query without terms none.

    Lists of the query's terms are read alone. In each block where all of them are, the shortest list is intersected with
    the others in order of their lengths.
    """
    wanted = terms(query)
    lists = index.where(F.col("term").isin(*wanted) if wanted else F.lit(False))
    met = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "term", "ids"))).alias("lists")).where(F.size("lists") == len(wanted))
    others = F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0)))
    both = F.aggregate(others, F.get("lists", F.lit(0))["ids"], lambda found, x: F.array_intersect(found, x["ids"]))
    return met.select(F.explode(both).alias("id"))


def matches(text: Column, query: str) -> Column:
    """Whether a text has every term of the query, for rows that no index covers; a query without terms matches nothing."""
    wanted = terms(query)
    return F.lit(False) if not wanted else F.size(F.array_except(F.array(*map(F.lit, wanted)), english_terms(text))) == 0


def title_or_text(notes: DataFrame, needle: str, key: str, title: str, text: str, index: DataFrame | None = None) -> DataFrame:
    """The notes whose title contains the needle, whatever its case, or whose text has every term of it.

    With an ``index`` no text is read: the found ids meet the notes once. % and _ of the needle stay wild cards in titles.
    """
    named = F.ilike(F.coalesce(F.col(title), F.lit("")), F.lit(f"%{needle}%"))
    if index is None:
        return notes.where(named | matches(F.col(text), needle))
    found = search(index, needle).select(F.col("id").alias(key), F.lit(True).alias("_found"))
    return notes.join(found, key, "left").where(named | F.col("_found").isNotNull()).drop("_found")
