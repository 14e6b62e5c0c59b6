"""Text scalars as column expressions, all inside the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the query and text rules.
TEMPORAL = r"(?i)\b(today|yesterday|tomorrow|last|next|this|january|february|march|april|may|june|july|august|september|october|november|december|\d{4})\b"
MONTH = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
NUMBER = r"(?<!\w)\d+(?:[.,]\d+)*(?:%|\b)"
TABLE_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"
HEADING = r"^#{1,6}\s+\S"
SHORT_FOLLOW_UP = 3
PREVIEW_CHARS = 240


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; a line end at its end opens no further line."""
    return F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")


def full_lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def share(items: Column, test) -> Column:
    """Of the items the share that passes; 0 for none."""
    n = F.size(items)
    return F.when(n > 0, F.size(F.filter(items, test)) / n).otherwise(F.lit(0.0))


def repair_hyphenation(text: Column) -> Column:
    """Joins words that a line end splits at a hyphen."""
    return F.regexp_replace(text, r"(?<=\w)-\s*\n\s*(?=\w)", "")


def squeeze(text: Column) -> Column:
    """Stripped, runs of blanks as one, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"[ \t]+", " "), r"\n{3,}", "\n\n")


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """One line of at most ``chars`` characters, an ellipsis in place of what is cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars - 3)), F.lit("...")))


def contextualised(query: Column, history: Column, words: int = SHORT_FOLLOW_UP, turns: int = 2) -> Column:
    """A query of few words gets the last messages of ``history`` (an array of texts) before it."""
    few = F.size(F.regexp_extract_all(query, F.lit(r"\w+"), 0)) <= words
    recent = F.slice(history, F.greatest(F.size(history) - turns + 1, F.lit(1)), turns)
    return F.when(few & (F.size(history) > 0), F.concat_ws("\n", F.array_join(recent, "\n"), query)).otherwise(query)


def is_temporal(query: Column) -> Column:
    return F.rlike(query, F.lit(TEMPORAL))


def invented_numbers(generated: Column, query: Column) -> Column:
    """Numbers of a generated text that its query lacks; commas in them do not count."""
    numbers = lambda c: F.transform(F.regexp_extract_all(F.lower(c), F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_except(numbers(generated), numbers(query))


def stem(word: Column) -> Column:
    """A light plural stemmer for lower-cased words."""
    w = F.lower(word)
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(F.rlike(w, F.lit("(ches|shes|ses|xes|zes)$")) & (n > 4), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), cut(1))
        .otherwise(w)
    )


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words of two or more characters, in first-seen order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), 0), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def rough_token_count(text: Column) -> Column:
    """The default tokenizer: words and single signs. Budgets are in its units."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), 0))


def is_table_line(line: Column) -> Column:
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return (bars >= 2) | F.rlike(line, F.lit(TABLE_RULE))


def table_rows(text: Column) -> Column:
    """The cells of each table row, separators left out: an array of arrays."""
    rows = F.filter(F.filter(F.transform(lines(text), strip), is_table_line), lambda x: ~F.rlike(x, F.lit(TABLE_RULE)))
    return F.transform(rows, lambda r: F.filter(F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), strip), lambda c: c != ""))


def table_headers(text: Column) -> Column:
    rows = table_rows(text)
    return F.when(F.size(rows) >= 2, F.get(rows, F.lit(0))).otherwise(F.array().cast("array<string>"))


def table_cells(text: Column) -> Column:
    rows = table_rows(text)
    return F.when(F.size(rows) >= 2, F.flatten(F.slice(rows, F.lit(2), F.size(rows)))).otherwise(F.array().cast("array<string>"))


def described_table(text: Column, section: Column | None = None) -> Column:
    """A table as sentences: its section, columns, number of rows, and each row as pairs of header and cell. Empty without a full row."""
    rows = table_rows(text)
    header = F.get(rows, F.lit(0))
    body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda r: F.size(r) == F.size(header))
    told = F.transform(body, lambda r: F.concat(F.array_join(F.zip_with(header, r, lambda h, c: F.concat_ws(" ", h, c)), ", "), F.lit(".")))
    lead = F.lit(None).cast("string") if section is None else F.when(F.length(section) > 0, F.concat(F.lit("Table from section: "), section, F.lit(".")))
    out = F.concat_ws(
        " ",
        lead,
        F.concat(F.lit("Columns: "), F.array_join(header, ", "), F.lit(".")),
        F.concat(F.lit("Contains "), F.size(body).cast("string"), F.when(F.size(body) == 1, F.lit(" row.")).otherwise(F.lit(" rows."))),
        F.array_join(told, " "),
    )
    return F.when((F.size(rows) >= 2) & (F.size(body) > 0), out).otherwise(F.lit(""))


def without_headings(text: Column) -> Column:
    return strip(F.array_join(F.filter(lines(text), lambda x: ~F.rlike(strip(x), F.lit(HEADING))), "\n"))


def entity_context(text: Column, entity: Column, around: int = 100) -> Column:
    """The entity with so many characters before and after its first place, or the text's first twice as many if it is absent; on one line."""
    at = F.instr(F.lower(text), F.lower(entity))
    start = F.greatest(at - around, F.lit(1))
    found = F.substring(text, start, at + F.length(entity) + around - start)
    return strip(F.replace(F.when(at > 0, found).otherwise(F.substring(text, 1, 2 * around)), F.lit("\n"), F.lit(" ")))


#: Parts of container names, and the services that they name.
SERVICES = {"backend": "backend", "agent": "agent", "qdrant": "qdrant", "postgres": "postgres", "redis": "redis", "loki": "loki", "grafana": "grafana", "fluent-bit": "fluent-bit"}


def service_of(tag: Column, services: Mapping[str, str] = SERVICES) -> Column:
    """The service that a log tag names, else other."""
    return F.coalesce(*[F.when(F.contains(tag, F.lit(name)), F.lit(label)) for name, label in services.items()], F.lit("other"))


def cache_key(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, 300)


def fingerprint(text: Column) -> Column:
    """16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name's version 5 UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def headings_separated(text: Column) -> Column:
    """Heading lines and short labels as sentences, so that their words do not run into the next line's."""
    bare = lambda x: F.regexp_replace(strip(x), r"^\d+(?:\.\d+)*\.?\s+", "")
    label = lambda x: (F.length(bare(x)) <= 80) & (F.size(F.split(bare(x), r"\s+")) <= 8) & ~F.rlike(strip(x), F.lit(r"[\t|]")) & F.rlike(bare(x), F.lit(r"^[A-Z][^.!?]*:?$"))
    closed = lambda x: F.regexp_replace(strip(x), ":+$", "")
    full = lambda x: F.when(F.rlike(closed(x), F.lit(r"[^.?!]$")), F.concat(closed(x), F.lit("."))).otherwise(x)
    return F.array_join(F.transform(lines(text), lambda x: F.when(F.rlike(strip(x), F.lit(HEADING)) | label(x), full(x)).otherwise(x)), "\n")


def heading_prefix(text: Column) -> Column:
    """(headings, body): the heading lines that open a text, with empty lines between them, and what follows."""
    every = lines(text)
    is_heading = lambda x: F.rlike(strip(x), F.lit(HEADING))
    first = F.array_position(F.transform(every, lambda x: ~is_heading(x) & (strip(x) != "")), F.lit(True)).cast("int")
    opened = is_heading(F.coalesce(F.get(every, F.lit(0)), F.lit("")))
    head = F.when(first > 0, F.slice(every, 1, F.greatest(first - 1, F.lit(0)))).otherwise(every)
    body = F.when(first > 0, strip(F.array_join(F.slice(every, F.greatest(first, F.lit(1)), F.size(every)), "\n"))).otherwise(F.lit(""))
    joined = F.array_join(F.filter(F.transform(head, strip), lambda x: x != ""), "\n\n")
    return F.struct(F.when(opened, joined).otherwise(F.lit("")).alias("headings"), F.when(opened, body).otherwise(strip(text)).alias("body"))


#: Openings of refusals and placeholders.
USELESS_SUMMARY = r"(?i)\b(i (?:cannot|can't|am unable to)|no (?:content|text|information) (?:was )?(?:provided|available)|as an ai)\b"
LIST_LINE = r"(?m)^\s*(?:[-*•·]|\d+[.)])\s"
LEAST_SUMMARY_WORDS = 5


def repaired_summary(text: Column) -> Column:
    """A reply as one paragraph: list marks go, lines are joined, and it ends with its last full sentence (or gets a full stop if it has none)."""
    bare = F.transform(full_lines(text), lambda x: strip(F.regexp_replace(x, r"^(?:[-*•·]|\d+[.)])\s*", "")))
    flat = strip(F.regexp_replace(F.array_join(F.filter(bare, lambda x: x != ""), " "), r"\s+", " "))
    whole = F.regexp_extract(flat, r"^(.*[.!?])(?=\s|$)", 1)
    return F.when((flat == "") | F.rlike(flat, F.lit(r"[.!?]$")), flat).when(whole != "", whole).otherwise(F.concat(flat, F.lit(".")))


def valid_summary(text: Column, no_lists: bool = False, whole_sentence: bool = False) -> Column:
    """The summary on one line, or the empty text if it is too short, a refusal, or (where asked) a list or cut off."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    bad = (flat == "") | (F.size(F.split(flat, " ")) < LEAST_SUMMARY_WORDS) | F.rlike(flat, F.lit(USELESS_SUMMARY))
    if no_lists or whole_sentence:
        bad = bad | F.rlike(flat, F.lit(LIST_LINE))
    if whole_sentence:
        bad = bad | ~F.rlike(flat, F.lit(r"[.!?]$"))
    return F.when(bad, F.lit("")).otherwise(flat)


def allowed_terms(reply: Column, allowed: Column, most: int | None = None) -> Column:
    """Lines of a reply, list marks stripped, that are allowed terms whatever their case: in the allowed form, each once."""
    said = F.transform(full_lines(reply), lambda x: F.lower(strip(F.regexp_replace(x, r"^(?:[-*]|\d+[.)])\s*", ""))))
    found = F.transform(F.array_distinct(said), lambda x: F.get(F.filter(allowed, lambda t: F.lower(t) == x), F.lit(0)))
    out = F.filter(found, lambda t: t.isNotNull())
    return out if most is None else F.slice(out, 1, most)


def month_or_day(day: Column, phrase: Column, zone: Column) -> Column:
    """(start, end) of the time that a phrase with the found ``day`` names: of a month without a day its first instant in the user's zone to the next month's, in UTC; else one UTC day."""
    whole_month = F.rlike(phrase, F.lit(MONTH)) & ~F.rlike(phrase, F.lit(r"\b\d{1,2}(?:st|nd|rd|th)?\b(?!\d)"))
    first = F.trunc(day, "month")
    start = F.when(whole_month, F.to_utc_timestamp(first.cast("timestamp"), zone)).otherwise(day.cast("timestamp"))
    end = F.when(whole_month, F.to_utc_timestamp(F.add_months(first, 1).cast("timestamp"), zone)).otherwise(F.date_add(day, 1).cast("timestamp"))
    return F.struct(start.alias("start"), end.alias("end"))


def date_precision(phrase: Column) -> Column:
    """day, month, year or relative, from the phrase's form."""
    return (
        F.when(F.rlike(phrase, F.lit(r"\d{4}-\d{2}-\d{2}")), "day")
        .when(F.rlike(phrase, F.lit(MONTH)) & F.rlike(phrase, F.lit(r"\b\d{1,2}\b")), "day")
        .when(F.rlike(phrase, F.lit(MONTH)), "month")
        .when(F.rlike(phrase, F.lit(r"^\s*\d{4}\s*$")), "year")
        .otherwise("relative")
    )


def question_list(reply: Column, keep: int = 5) -> Column:
    """Questions of a reply by line: bullets stripped, a question mark at the end, yes-or-no openers left out, at most ``keep``."""
    bare = F.transform(full_lines(reply), lambda x: strip(F.regexp_replace(x, r"^(?:[-*•]+|\d+[.)])\s*", "")))
    asked = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.when(x.endswith("?"), x).otherwise(F.concat(F.regexp_replace(x, r"[.!\s]+$", ""), F.lit("?"))))
    opened = F.filter(asked, lambda x: ~F.rlike(x, F.lit(r"(?i)^(is|are|was|were|do|does|did|can|could|will|would|should|has|have|had)\b")))
    return F.slice(F.array_distinct(opened), 1, keep)
