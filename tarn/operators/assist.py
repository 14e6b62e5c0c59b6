"""Messages, JSON arguments, dates in texts, and evidence: the small operators around a retrieval."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import rough_token_count

MESSAGE_OVERHEAD = 4
MOST_KEYWORDS = 25
MOST_SNIPPETS = 3
PATH_DEPTH = 8
BLOCKED_KEYS = frozenset({"__proto__", "__class__", "constructor", "prototype"})


def message_tokens(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Messages and tokens of each key; a message costs its text and an overhead."""
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.sum(rough_token_count(F.coalesce(text, F.lit(""))) + MESSAGE_OVERHEAD).alias("tokens"))


def json_lookup(raw: Column, path: str) -> Column:
    """The value at a dotted path as text; null for a path that is too deep or has a blocked key, and where there is nothing."""
    keys = [k for k in path.split(".") if k]
    if not keys or len(keys) > PATH_DEPTH or BLOCKED_KEYS & set(keys) or not all(re.fullmatch(r"[A-Za-z0-9_\-]+", k) for k in keys):
        return F.lit(None).cast("string")
    return F.get_json_object(raw, "$" + "".join(f"[{k}]" if k.isdigit() else f".{k}" for k in keys))


def json_kind(raw: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; invalid for anything else."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return (
        F.when(F.try_parse_json(raw).isNull(), "invalid")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def argument_errors(raw: Column, expected: Mapping[str, str], required: Sequence[str] = ()) -> Column:
    """What is wrong with a JSON object of arguments, as an array of sentences."""
    found = []
    for name, want in expected.items():
        value = F.expr("null") if not re.fullmatch(r"\w+", name) else F.variant_get(F.try_parse_json(raw), f"$.{name}", "string")
        present = value.isNotNull()
        kind = json_kind(F.to_json(F.variant_get(F.try_parse_json(raw), f"$.{name}", "variant")))
        if name in required:
            found.append(F.when(~present, F.lit(f"{name} is missing")))
        found.append(F.when(present & (kind != want), F.concat(F.lit(f"{name} should be {want}, not "), kind)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def dates_in(text: Column) -> Column:
    """Dates that a text states in ISO form, as an array of (text, date), each once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1))
    return F.filter(F.transform(found, lambda d: F.struct(d.alias("text"), F.try_to_date(d).alias("date"))), lambda x: x["date"].isNotNull())


def note_evidence(hits: DataFrame, note: str, score: str, place: str, keywords: str, snippet: str) -> DataFrame:
    """Per note: best score, matches, up to 25 sorted distinct keywords, and its first three distinct snippets."""
    return hits.groupBy(note).agg(
        F.max(score).alias("best"),
        F.count("*").alias("matches"),
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(keywords)))), 1, MOST_KEYWORDS).alias("keywords"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(place, snippet))), lambda x: x[snippet])), 1, MOST_SNIPPETS).alias("snippets"),
    )


def fit_sections(sections: Column, budget: int) -> Column:
    """Sections (priority, n, ...) in order of priority as far as they fit; the rest is left out."""
    from tarn.operators.context import budget_fill

    return budget_fill(F.array_sort(sections), budget)


def usage_delta(start: Column, end: Column) -> Column:
    """End less start for each key of two maps of counts."""
    keys = F.array_union(F.map_keys(start), F.map_keys(end))
    value = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(end, k) - value(start, k))))


def grounded(answer: Column, sources: Column) -> Column:
    """The answer, with a list of its sources if it names none of them."""
    cited = F.exists(sources, lambda s: F.contains(answer, s))
    return F.when(cited | (F.size(sources) == 0), answer).otherwise(F.concat(answer, F.lit("\n\nSources: "), F.array_join(sources, ", ")))


def is_simple_query(query: Column) -> Column:
    """A short question without a comparison, list or step word needs no plan."""
    words = F.size(F.regexp_extract_all(query, F.lit(r"\w+"), 0))
    return (words <= 12) & ~F.rlike(query, F.lit(r"(?i)\b(compare|versus|vs|then|after that|each|every|all of|steps?|plan)\b"))


def rendered(template: str, **values: str) -> str:
    """A prompt with its {names} filled in; a name without a value is an error."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), template)
