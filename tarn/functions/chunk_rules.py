"""Chunk types by ordered rules, each over the lines of a text. The first rule that matches names the type, else content.

The rules run in Arrow batches, each with its patterns compiled once; they look at a line once a rule and keep nothing between texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import HEADING

#: Line patterns of the rules.
FENCED_JSON = r"(?i)^```json(?:\s|$)"
FENCE = r"^(`{3,}|~{3,})"
CODE_STARTS = r"(?i)^(python|pip|npm|npx|yarn|node|docker|kubectl|helm|git|curl|wget|cd |ls |mkdir|rm |source |export |\./|bash |sh |chmod|alembic|uvicorn|gunicorn|celery|airflow|terraform|ansible|make |gradle|mvn )"
CODE_LINES = r"^(?:(?:def |class |import |from |return |async def )|(?:const |let |var |function |=>|async function )|(?i:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b|[a-zA-Z_]\w*\s*=\s*.+|\{|(?:if|for|while|switch|try|catch)\s*[({]|(?:FROM|RUN|CMD|ENTRYPOINT|COPY|ENV|EXPOSE|WORKDIR|ARG|LABEL)\s)"
QUESTION = r"(?i)^(Q[.:]\s|Question[.:]\s)"
ANSWER = r"(?i)^(A[.:]\s|Answer[.:]\s)"
SPEAKER = r"^[A-Z][a-zA-Z\s]{1,30}:\s*$"
NAME = r"^[A-Z][a-zA-Z\s]{1,30}$"
CLOCK = r"(?i)^\d{1,2}:\d{2}\s*(AM|PM)?$"
STAMPED = r"^\[\d{2}:\d{2}(:\d{2})?\]\s+\w.*:\s*$"
NO_DIALOGUE = r"^(?:`|[-*+]\s|\d+[.)]\s|#{1,6}\s|~~~|[A-Za-z][A-Za-z\s]{0,40}:\s+\S)"
DEFINITION = r"^[A-Z][A-Za-z0-9\s/\-]{0,40}\s*[:—–]\s*\S"
GLOSSARY = r"(?i)\b(?:glossary|definitions?|terms?)\b"
APPENDIX = r"(?i)^(?:#{1,6}\s+)?appendix(?:\s+[A-Z0-9]+)?(?:\s*[:—–-]|\b)"
ATTRIBUTION = r"^[—–\-]\s*\w"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PHONE = r"^(?:\+?\d[\d\s\-().]{7,}\d|\(\d{3}\)\s*\d{3}[\-\s]\d{4}|\d{3}[\-\s]\d{3}[\-\s]\d{4})$"
CONTACT_LABEL = r"(?i)^(email|phone|tel|fax|mobile|contact)\s*:"
STREET = r"(?i)^\d+\s+[A-Z][a-zA-Z\s]+(Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Way|Place|Pl|Court|Ct|Parkway|Pkwy|Highway|Hwy|Straße|strasse)\b"
STREET_BEFORE_NUMBER = r"(?i)^[A-Z][a-zA-Z\s]+(?:Straße|strasse|Street|St|Road|Rd|Avenue|Ave)\s+\d+[A-Za-z]?\b"
CITY = r"^(?:[A-Za-z\s]+,\s*[A-Z]{2}\s+\d{5}(-\d{4})?|[A-Za-z\s]+,\s+[A-Za-z\s]+)$"
POSTAL = r"^(?:\d{4,6}|[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})$"
BUILDING = r"(?i)^(Building|Floor|Suite|Unit|Apt|Room|Block|P\.?O\.?\s*Box)\s"
ORDERED = r"^(?:\d+\.\s+\S|\d+\.\d+(?:\.\d+)?\s+\S|[A-Z]\.\s+\S|[A-Z]\)\s+\S|\([ivxlcdmIVXLCDM]+\)\s+\S|[ivxlcdm]+\.\s+\S|[IVX]+\.\s+\S)"
BULLET = r"^[-*+]\s+(\[[ xX]\]\s+)?.+"
TABLE_RULE_LINE = r"^[|\s\-:]+$"


_BLANKS = " \t\n\x0b\f\r"
_LINE_END = re.compile("\r\n|[\n\x0b\f\r\x85\u2028\u2029]")


def lines_of(text: str) -> list[str]:
    """``_LINE_END.split``, by the string's own split where both mean the same line ends."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text:
        return _LINE_END.split(text)
    out = text.splitlines()
    return out if out and text[-1] not in "\n\x0b\f\r\x85\u2028\u2029" else [*out, ""]


def _test(pattern: str, first: str = "", inside: str = "") -> Callable[[str], bool]:
    """Whether a pattern is found. Where ``first`` or ``inside`` is given, no match begins otherwise than with one of these signs, or lacks all of them."""
    found = re.compile(pattern, re.ASCII).search
    if first:
        signs = frozenset(first)
        return lambda x: x[:1] in signs and found(x) is not None
    if len(inside) == 1:
        return lambda x: inside in x and found(x) is not None
    if inside:
        one, *more = inside
        return lambda x: (one in x or any(c in x for c in more)) and found(x) is not None
    return lambda x: found(x) is not None


_DIGITS = "0123456789"
_heading, _question, _answer = _test(HEADING, "#"), _test(QUESTION, "qQ"), _test(ANSWER, "aA")
_speaker, _clock, _stamped = map(_test, (SPEAKER, CLOCK, STAMPED))
_code_start, _code_line, _no_dialogue, _definition = _test(CODE_STARTS), _test(CODE_LINES), _test(NO_DIALOGUE), _test(DEFINITION, inside=":—–")
_glossary, _attribution, _postal, _building, _table_rule = map(_test, (GLOSSARY, ATTRIBUTION, POSTAL, BUILDING, TABLE_RULE_LINE))
_appendix, _email, _phone = _test(APPENDIX, "aA#"), _test(EMAIL, inside="@"), _test(PHONE, "+(" + _DIGITS)
_contact_label, _street, _street_before = _test(CONTACT_LABEL, inside=":"), _test(STREET, _DIGITS), _test(STREET_BEFORE_NUMBER)
_city, _ordered, _bullet = _test(CITY, inside=","), _test(ORDERED, inside=".)"), _test(BULLET, "-*+")
_json_fence, _fence, _name, _json_key, _json_text = map(_test, (FENCED_JSON, FENCE, NAME, r'"[^"]+"\s*:', r'"[^"]+"'))


def _quoted(x: str) -> bool:
    return len(x) > 3 and x[0] == x[-1] == '"' or len(x) > 1 and x[0] == ">"


def heading_prefix(text: str) -> tuple[str, str]:
    """(headings, body): as ``text.heading_prefix``, of one text."""
    every = lines_of(text)
    if len(every) > 1 and not every[-1]:
        every.pop()
    every = [x.strip(_BLANKS) for x in every]
    if not _heading(every[0]):
        return "", text.strip(_BLANKS)
    first = next((i for i, x in enumerate(every) if x and not _heading(x)), len(every))
    return "\n\n".join(x for x in every[:first] if x), "\n".join(lines_of(text)[first : len(every)]).strip(_BLANKS)


class Parts:
    """What the rules look at: the stripped text, its lines, and the text behind its leading headings (or all of it)."""

    def __init__(self, text: str | None):
        self.text = (text or "").strip(_BLANKS)

    @cached_property
    def lines(self) -> list[str]:
        return [x.strip(_BLANKS) for x in lines_of(self.text)]

    @cached_property
    def own(self) -> list[str]:
        return [x for x in self.lines if x]

    @cached_property
    def target(self) -> str:
        if not self.lines[0] or not _heading(self.lines[0]):
            return self.text
        raw = lines_of(self.text)
        first = next((i for i, x in enumerate(self.lines) if not _heading(x)), len(raw))
        return "\n".join(raw[first:]).strip(_BLANKS) or self.text

    @cached_property
    def inner(self) -> list[str]:
        return self.own if self.target == self.text else [y for x in lines_of(self.target) if (y := x.strip(_BLANKS))]

    @cached_property
    def is_faq(self) -> bool:
        asks, answers = sum(map(_question, self.own)), sum(map(_answer, self.own))
        return asks >= 1 and answers >= 1 and abs(asks - answers) <= 1

    @cached_property
    def is_contact(self) -> bool:
        return any(_email(x) or _phone(x) or _contact_label(x) for x in self.own)


def _share(n: int, items: list[str]) -> float:
    return n / len(items) if items else 0.0


def _json(p: Parts) -> bool:
    t = p.target
    wrapped = t[:1] == "{" and t[-1:] == "}" or t[:1] == "[" and t[-1:] == "]"
    return wrapped and (_json_key(t) or _json_text(t) and len(t) > 10)


def _code(p: Parts) -> bool:
    return len(p.inner) >= 3 and _share(sum(_code_start(x) or _code_line(x) for x in p.inner), p.inner) >= 0.6


def _table(p: Parts) -> bool:
    rows = [x for x in p.inner if x.count("|") >= 2]
    return _share(len(rows), p.inner) >= 0.6 and sum(not _table_rule(x) for x in rows) >= 2


def _transcript(p: Parts) -> bool:
    """Two or more speakers, each named on a line before what they say, on the line before a clock time, or behind a time stamp."""
    named, timed, stamped = set(), set(), set()
    for i, x in enumerate(p.lines):
        if x[-1:] == ":" and _speaker(x):
            after = next((y for y in p.lines[i + 1 :] if y), None)
            if after is not None and not _no_dialogue(after):
                named.add(x[:-1].strip(_BLANKS).lower())
        elif i and x[:1].isdigit() and _clock(x) and _name(p.lines[i - 1]):
            timed.add(p.lines[i - 1].lower())
        if x[:1] == "[" and _stamped(x):
            stamped.add(x.partition("]")[2].strip(_BLANKS).rstrip(":").lower())
    return max(len(named), len(timed), len(stamped)) >= 2


def _address(p: Parts) -> bool:
    own = p.own
    return not p.is_contact and (any(_street(x) or _street_before(x) or _city(x) for x in own) or any(map(_postal, own)) and any(map(_building, own)))


def _is_glossary(p: Parts) -> bool:
    if p.is_faq or len(p.own) < 2:
        return False
    headings, terms = [x for x in p.own if _heading(x)], sum(map(_definition, p.own))
    return terms >= 2 and _share(terms, p.own) >= 0.5 and (not headings or any(map(_glossary, headings)))


def _quote(p: Parts) -> bool:
    quoted = [x for x in p.inner if _quoted(x)]
    return bool(quoted) and all(_quoted(x) or _attribution(x) for x in p.inner)


def _most(test: Callable[[str], bool], least: float) -> Callable[[Parts], bool]:
    def rule(p: Parts) -> bool:
        n = sum(map(test, p.inner))
        return n >= 2 and _share(n, p.inner) >= least

    return rule


#: In the order in which they are tried.
RULES: dict[str, Callable[[Parts], bool]] = {
    "heading_only": lambda p: bool(p.own) and all(map(_heading, p.own)),
    "json_fenced": lambda p: _json_fence(p.text),
    "code_fenced": lambda p: _fence(p.text),
    "json": _json,
    "code": _code,
    "table": _table,
    "faq": lambda p: p.is_faq,
    "transcript": _transcript,
    "quote": _quote,
    "contact": lambda p: p.is_contact,
    "address": _address,
    "appendix": lambda p: any(map(_appendix, p.own[:3])),
    "glossary": _is_glossary,
    "structured_list": _most(_ordered, 0.4),
    "list": _most(_bullet, 0.6),
}
#: What a rule names if not its own name.
RULE_TYPES = {"json_fenced": "json", "code_fenced": "code"}


def type_of(text: str | None) -> str:
    parts = Parts(text)
    if not parts.text:
        return "content"
    name = next((name for name, rule in RULES.items() if rule(parts)), "content")
    return RULE_TYPES.get(name, name)


def rule_flags(text: Column) -> Column:
    """A struct of each rule's result, whether or not an earlier one matches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([[bool(rule(p)) for rule in RULES.values()] for p in map(Parts, s)], columns=list(RULES), dtype=bool)

    return F.pandas_udf(run, ", ".join(f"{name} boolean" for name in RULES))(text)


def chunk_type(text: Column) -> Column:
    """Null and blank texts are content."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([type_of(t) for t in s], dtype=object)

    return F.pandas_udf(run, "string")(text)


def with_chunk_type(df: DataFrame, text: str, out: str = "chunk_type") -> DataFrame:
    return df.withColumn(out, chunk_type(F.col(text)))
