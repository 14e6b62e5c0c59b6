"""English words to their stems, by the rules of the published Snowball English algorithm, and texts to their terms.

A word's two regions are kept as lengths; each step is a table of endings, longest first, with what stands for them and
the condition under which they go.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Words with stems of their own, and words that the later steps leave alone.
OWN_STEMS = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split()) | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
LEFT_ALONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings behind which the first region starts at once.
LONG_STARTS = ("gener", "commun", "arsen")
#: Endings and what stands for them, where the first region has them.
SECOND = dict(
    x.split(":")
    for x in """tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al
    fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:""".split()
)
THIRD = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
VOWELS, DOUBLES, LI_BEFORE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile(r"[aeiouy]")
_TERM = re.compile(r"[^\W_]+")


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where the regions behind the first and the second vowel-consonant pair start."""
    start = next((len(s) for s in LONG_STARTS if word.startswith(s)), None)
    if start is None:
        start = m.end() if (m := _REGION.search(word)) else len(word)
    return start, m.end() if (m := _REGION.search(word, start)) else len(word)


def _is_short(word: str, first: int) -> bool:
    return first >= len(word) and _SHORT_END.search(word) is not None


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    """Endings of past and continuous forms; what is left may need an e or lose a doubled letter."""
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    left = word[: -len(end)]
    if end in ("eed", "eedly"):
        return left + "ee" if len(left) >= first else word
    if not _VOWEL.search(left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left.endswith(DOUBLES):
        return left[:-1]
    return left + "e" if _is_short(left, first) else left


def _replaced(word: str, endings: dict[str, str], start: int, allowed: Callable[[str, str], bool]) -> str:
    """The longest ending goes if it lies behind ``start`` and what is before it allows that; a shorter one never takes its place."""
    end = _ending(word, endings)
    if end is None:
        return word
    left = word[: -len(end)]
    return left + endings[end] if len(left) >= start and allowed(left, end) else word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    first, second = _regions(word)
    if end := _ending(word, ("'", "'s", "'s'")):
        word = word[: -len(end)]
    word = _plural(word)
    if word in LEFT_ALONE:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _replaced(word, SECOND, first, lambda left, end: end not in ("ogi", "li") or left[-1:] in ("l" if end == "ogi" else LI_BEFORE) and left != "")
    word = _replaced(word, THIRD, first, lambda left, end: end != "ative" or len(left) >= second)
    word = _replaced(word, FOURTH, second, lambda left, end: end != "ion" or left[-1:] in ("s", "t"))
    left = word[:-1]
    if word.endswith("e") and (len(left) >= second or len(left) >= first and not _SHORT_END.search(left)) or word.endswith("ll") and len(left) >= second:
        word = left
    return word.replace("Y", "y")


class _Stems(dict):
    """Stems of words; a bounded memory of them."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = stem(word)
        return out


_STEMS = _Stems()


def terms(text: str | None) -> list[str]:
    """The stems of a text's words, without stop words, each once, in order of their first place."""
    words = dict.fromkeys(_TERM.findall((text or "").lower()))
    return list(dict.fromkeys(_STEMS[w] for w in words if w not in STOP_WORDS))


def english_terms(text: Column) -> Column:
    """``terms`` over a column, in Arrow batches; null has none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([terms(t) for t in s], dtype=object)

    return F.pandas_udf(run, "array<string>")(F.coalesce(text, F.lit("")))
