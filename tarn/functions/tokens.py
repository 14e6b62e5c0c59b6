"""Tokenizers: words and signs, and byte pairs by the ranks of a vocabulary file. Both count, and cut windows at the tokens' places."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how a text falls into words before pairs are joined.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 200_000
#: Words of more bytes are joined with a heap.
SHORT_WORD = 64
_NO_RANK = 1 << 62


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...

    def windows(self, text: str, size: int, overlap: int = 0) -> list[str]: ...


def _stops(count: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The first and last-but-one places of windows of ``size`` over ``count`` tokens."""
    step = max(1, size - max(0, min(overlap, size - 1)))
    for start in range(0, max(1, count - size + step), step):
        yield start, min(start + size, count)


class Words:
    """Words of ASCII letters and digits, and single other signs."""

    _token = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")

    def count(self, text: str) -> int:
        return len(self._token.findall(text))

    def windows(self, text: str, size: int, overlap: int = 0) -> list[str]:
        """Windows of ``size`` tokens as they stand in the text; of one that fits, all of it."""
        at = [m.span() for m in self._token.finditer(text)]
        if len(at) <= size:
            return [clean] if (clean := text.strip()) else []
        return [text[at[a][0] : at[b - 1][1]] for a, b in _stops(len(at), size, overlap)]


class _Counts(dict):
    """The number of tokens of each word; a bounded memory of them. Very long words are not kept."""

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs

    def __reduce__(self):
        return _Counts, (self.pairs,)

    def __missing__(self, word: str) -> int:
        n = len(self.pairs.ends(word.encode("utf-8", "surrogatepass")))
        if len(word) <= SHORT_WORD:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


class BytePairs:
    """Joins, in each word, the neighbouring byte strings whose union has the lowest rank, of equal ones the leftmost, until none has a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN):
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.counts: dict[str, int] = _Counts(self)

    def ends(self, word: bytes) -> list[int]:
        """Where the tokens of a word end."""
        n = len(word)
        if word in self.ranks or n < 2:
            return [n] if n else []
        return self._ends_of_short(word) if n <= SHORT_WORD else self._ends_of_long(word)

    def _ends_of_short(self, word: bytes) -> list[int]:
        """By a list of the ranks of neighbours, of which only those beside a join change."""
        rank = self.ranks.get
        cuts = list(range(len(word) + 1))
        joins = [rank(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
        while joins and (least := min(joins)) != _NO_RANK:
            i = joins.index(least)
            del cuts[i + 1], joins[i]
            if i < len(joins):
                joins[i] = rank(word[cuts[i] : cuts[i + 2]], _NO_RANK)
            if i:
                joins[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], _NO_RANK)
        return cuts[1:]

    def _ends_of_long(self, word: bytes) -> list[int]:
        """Candidates wait in a heap by rank and place; one whose parts have changed is passed over."""
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(word[i : after[j]])) is not None:
                heapq.heappush(heap, (rank, i, after[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if after[i] > 0 else n
            if j >= n or after[j] != end:
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [e for e in after if e > 0]

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            found = tuple(self.ends(word.encode("utf-8", "surrogatepass")))
            if len(word) <= 64:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def offsets(self, text: str) -> tuple[bytes, list[int]]:
        """The text's bytes, and where each token ends in them."""
        out, at, known = [], 0, self.cache
        for word in self.words.findall(text):
            ends = known.get(word) or self._word(word)
            if len(ends) == 1:
                at += ends[0]
                out.append(at)
            else:
                out += [at + e for e in ends]
                at = out[-1]
        return text.encode("utf-8", "surrogatepass"), out

    def encode(self, text: str) -> list[int]:
        data, ends = self.offsets(text)
        return [self.ranks[data[a:b]] for a, b in zip([0, *ends], ends, strict=False)]

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.words.findall(text)))

    def windows(self, text: str, size: int, overlap: int = 0) -> list[str]:
        """Windows of ``size`` tokens, stripped, without empty ones; a character that a window cuts in two is replaced by a mark in both."""
        clean = text.strip()
        return self._cut(clean, *self.offsets(clean), size, overlap)

    def counted_windows(self, text: str, size: int, overlap: int = 0) -> tuple[int, list[str]]:
        """``count`` and ``windows``; the text is taken apart once, where it has no white space at its ends."""
        clean = text.strip()
        data, ends = self.offsets(clean)
        return len(ends) if clean == text else self.count(text), self._cut(clean, data, ends, size, overlap)

    def _cut(self, clean: str, data: bytes, ends: list[int], size: int, overlap: int) -> list[str]:
        if len(ends) <= size:
            return [clean] if clean else []
        starts = [0, *ends]
        cut = (data[starts[a] : ends[b - 1]].decode("utf-8", "replace").strip() for a, b in _stops(len(ends), size, overlap))
        return [w for w in cut if w]


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank, as vocabulary files have them."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_pairs(spark: SparkSession, path: str, pattern: str = WORD_PATTERN) -> BytePairs:
    """The tokenizer of a vocabulary file, which only the driver reads (through Spark, so it may lie in any store); it is of bounded size and travels with the functions."""
    rows = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return BytePairs(read_ranks([r["value"] for r in rows]), pattern)


@lru_cache(maxsize=1)
def words() -> Words:
    return Words()


def token_count(tokenizer: Tokenizer, text: Column) -> Column:
    """Tokens of each text, null as empty, in Arrow batches."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(tokenizer.count).astype("int64")

    return F.pandas_udf(run, "long")(F.coalesce(text, F.lit("")))


def token_windows(tokenizer: Tokenizer, text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of at most ``size`` tokens of each text, each with ``overlap`` tokens of the one before it."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([tokenizer.windows(t, size, overlap) for t in s], dtype=object)

    return F.pandas_udf(run, "array<string>")(F.coalesce(text, F.lit("")))


def counted_windows(tokenizer: BytePairs, text: Column, size: int, overlap: int = 0) -> Column:
    """A struct of ``tokens`` and ``windows``: ``token_count`` and ``token_windows`` in one pass."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([tokenizer.counted_windows(t, size, overlap) for t in s], columns=["tokens", "windows"])

    return F.pandas_udf(run, "struct<tokens:long,windows:array<string>>")(F.coalesce(text, F.lit("")))
