"""Replaceable stand-ins for models: a tokenizer, embedders, a reranker, a summariser and an entity finder. All are deterministic and need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.semantic import Splitter
from tarn.functions.text import full_lines, jaccard, rough_token_count, strip, tokens
from tarn.functions.tokens import Tokenizer, Words, token_count


class Provider(Protocol):
    """What a stage asks of a model, as functions from columns to columns."""

    def count_tokens(self, text: Column) -> Column: ...

    def splitter(self) -> Splitter: ...

    def embed(self, text: Column) -> Column: ...

    def rerank(self, query: Column, text: Column) -> Column: ...

    def summarise(self, text: Column) -> Column: ...

    def entities(self, text: Column) -> Column: ...


#: Words whose places a worker remembers.
CACHED_WORDS = 200_000


class _Places(dict):
    """The place of each word among ``dim``, behind them again if its sign is negative; a bounded memory of them."""

    def __init__(self, dim: int):
        self.dim = dim

    def __reduce__(self):
        return _Places, (self.dim,)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        at = self[word] = h % self.dim + (0 if h >> 63 else self.dim)
        return at


def hashed_vectors(dim: int) -> Callable[[Sequence[str]], np.ndarray]:
    """Signed hashing of words into ``dim`` places, scaled to length 1; texts without words give zeros."""

    places = _Places(dim)

    def embed(texts: Sequence[str]) -> np.ndarray:
        words = [(text or "").lower().split() for text in texts]
        row = np.repeat(np.arange(len(words)) * 2 * dim, [len(w) for w in words])
        found = np.bincount(row + np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.int64, len(row)), minlength=len(words) * 2 * dim).reshape(len(words), 2, dim)
        out = (found[:, 0] - found[:, 1]).astype(np.float32)
        norms = np.array([np.linalg.norm(v) for v in out], dtype=np.float32)
        norms[norms == 0] = 1.0
        return out / norms[:, None]

    return embed


def hashed_embedding(dim: int) -> Callable[[Column], Column]:
    """``hashed_vectors`` over a column; null as empty."""
    embed = hashed_vectors(dim)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embed(list(s)).tolist(), dtype=object)

    return F.pandas_udf(run, "array<float>")


@dataclass
class Offline:
    """The offline stand-in; it says nothing about the quality of a real model."""

    dim: int = 64
    summary_chars: int = 300
    #: Counts and cuts tokens; without one, words and signs are counted by built-in expressions.
    tokenizer: Tokenizer | None = None
    #: Prose is split where its meaning turns, by the stand-in's vectors; off, by runs of sentences.
    by_meaning: bool = True

    def count_tokens(self, text: Column) -> Column:
        return rough_token_count(text) if self.tokenizer is None else token_count(self.tokenizer, text)

    def splitter(self) -> Splitter:
        return Splitter(self.tokenizer or Words(), hashed_vectors(self.dim) if self.by_meaning else None)

    def embed(self, text: Column) -> Column:
        return hashed_embedding(self.dim)(text)

    def sparse(self, text: Column) -> Column:
        """Term counts, as a map."""
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), 0)
        return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)).cast("double"))))

    def rerank(self, query: Column, text: Column) -> Column:
        return jaccard(tokens(query), tokens(text))

    def summarise(self, text: Column) -> Column:
        """The first lines up to the limit, cut behind the last full stop in it if there is one."""
        flat = F.array_join(full_lines(F.coalesce(text, F.lit(""))), " ")
        head = F.substring(flat, 1, self.summary_chars)
        stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
        return F.when(F.length(flat) <= self.summary_chars, flat).when(F.instr(head, ".") > 0, F.substring(head, F.lit(1), stop)).otherwise(strip(head))

    def entities(self, text: Column) -> Column:
        """Runs of capitalised words that do not begin a sentence."""
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)"), 1)
        return F.array_distinct(F.transform(found, lambda e: F.regexp_replace(e, r"'s$", "")))
