"""Ranking and pruning of terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import stem

MOST_CANDIDATES = 40
MOST_TERMS = 15


def ranked_terms(terms: DataFrame, doc: str, section: str, position: str, term: str = "term", most: int | None = MOST_CANDIDATES) -> DataFrame:
    """Per document the terms with: distinct sections, words, occurrences, and place.

    Terms are grouped in lower case and shown as first seen. Those of one section and one word are left out. The
    order is by sections, words, occurrences and length, all descending, then by the term.
    """
    clean = terms.select(doc, section, position, F.trim(term).alias("term")).where(F.col("term") != "").withColumn("key", F.lower("term"))
    grouped = clean.groupBy(doc, "key").agg(F.count("*").alias("occurrences"), F.count_distinct(section).alias("sections"), F.min_by("term", position).alias("term"))
    sized = grouped.withColumn("words", F.size(F.split("term", r"\s+"))).where((F.col("sections") >= 2) | (F.col("words") >= 2))
    w = Window.partitionBy(doc).orderBy(F.col("sections").desc(), F.col("words").desc(), F.col("occurrences").desc(), F.length("term").desc(), F.col("key"))
    placed = sized.withColumn("place", F.row_number().over(w))
    return placed if most is None else placed.where(F.col("place") <= most)


def phrase_tokens(phrase: Column) -> Column:
    """Stemmed words of a phrase; hyphenated words whole and in parts."""
    words = F.split(F.trim(phrase), r"\s+")
    parts = F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")), F.filter(F.split(w, "-"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.transform(F.concat(words, parts), stem))


def pruned(terms: Column) -> Column:
    """Greedy: a term whose words are all in a kept one is left out; kept ones whose words it covers go when it comes."""
    covers = lambda big, small: F.size(F.array_except(phrase_tokens(small), phrase_tokens(big))) == 0

    def step(kept: Column, term: Column) -> Column:
        known = F.exists(kept, lambda k: covers(k, term))
        rest = F.filter(kept, lambda k: ~covers(term, k))
        return F.when(known, kept).otherwise(F.array_append(rest, term))

    return F.aggregate(terms, F.array().cast("array<string>"), step)


def best_terms(terms: DataFrame, doc: str, section: str, position: str, term: str = "term", candidates: int = MOST_CANDIDATES, keep: int = MOST_TERMS) -> DataFrame:
    """(doc, terms): all of a document's ranked terms are pruned, the first ``candidates`` of the rest are candidates, and the first ``keep`` of these stay."""
    placed = ranked_terms(terms, doc, section, position, term, most=None)
    ordered = placed.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    return ordered.select(doc, F.slice(pruned(F.col("terms")), 1, min(candidates, keep)).alias("terms"))


def entity_evidence(mentions: DataFrame, doc: str, entity: str, label: str, context: str, position: str) -> DataFrame:
    """Per entity the sorted labels and the first two distinct contexts."""
    first = F.transform(F.array_sort(F.collect_list(F.struct(position, context))), lambda x: x[context])
    return mentions.groupBy(doc, F.lower(entity).alias("key")).agg(F.sort_array(F.collect_set(label)).alias("labels"), F.slice(F.array_distinct(first), 1, 2).alias("contexts"))


def complete_names(names: DataFrame, doc: str, name: str) -> DataFrame:
    """Each partial name with the one longer name of its document that holds all its words, if there is just one."""
    words = names.select(doc, name).distinct().withColumn("_w", F.array_distinct(F.split(F.lower(name), r"\s+")))
    longer = words.select(F.col(doc), F.col(name).alias("full"), F.col("_w").alias("_f"), F.explode("_w").alias("_t"))
    short = words.withColumn("_t", F.get("_w", F.lit(0)))
    met = short.join(longer, [doc, "_t"]).where((F.size("_f") > F.size("_w")) & (F.size(F.array_except("_w", "_f")) == 0))
    unique = met.groupBy(doc, name).agg(F.count_distinct("full").alias("_n"), F.min("full").alias("full")).where("_n = 1").drop("_n")
    return names.join(unique, [doc, name], "left")


_BARS = r"[-:| ]+"


def clean_terms(df: DataFrame, column: str, function_words: frozenset[str], noise: frozenset[str], out: str = "term") -> DataFrame:
    """Terms without function words at either end, of at most four words; null where nothing but noise is left."""
    import re

    def tidy(raw: str | None) -> str | None:
        text = re.sub(r"\s+", " ", (raw or "").replace("|", " ")).strip()
        if re.fullmatch(_BARS, text or "-"):
            return None
        words = text.split(" ")
        lo, hi = 0, len(words)
        while hi - lo > 1 and words[lo].lower() in function_words:
            lo += 1
        while hi - lo > 1 and words[hi - 1].lower() in function_words:
            hi -= 1
        words = words[lo : min(hi, lo + 4)]
        text = " ".join(words)
        alone = len(words) == 1 and (text.lower() in noise or text.lower() in function_words)
        return None if len(text) < 3 or alone or text.endswith("-") else text

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(tidy, na_action=None)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(column)))
