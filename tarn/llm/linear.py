"""Presence features of texts, their selection over labelled rows, and sparse linear models fitted on the driver.

What reaches the driver is bounded: at most ``MAX_LABELLED`` labelled rows of a few selected features each, and at
most ``MAX_FEATURES`` features.
"""

from __future__ import annotations

import operator
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches, written

#: Bounds of the fitted models.
MAX_LABELLED = 20_000
MAX_FEATURES = 4096
#: Features whose counts differ between classes by fewer standard errors are left out.
LEAST_Z = 3.5
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"\w+")
#: Words whose features a worker remembers.
CACHED_WORDS = 200_000


def word_features(word: str) -> list[str]:
    """The word, and its beginnings, which inflected and compound forms share."""
    return ["w:" + word, *(f"p:{word[:n]}" for n in PREFIXES if len(word) >= n)]


def shape_features(text: str, words: list[str]) -> list[str]:
    """Bucketed ratios of a text's form."""
    n, chars = len(words), max(1, len(text))
    lines = text.split("\n")
    counts = Counter(words)
    ratios = {
        "size": min(9, n.bit_length()),
        "distinct": int(10 * len(counts) / max(1, n)),
        "top": int(10 * max(counts.values(), default=0) / max(1, n)),
        "length": min(14, int(sum(map(len, words)) / max(1, n))),
        "lines": int(10 * len(set(lines)) / len(lines)),
        "bars": min(9, int(100 * text.count("|") / chars)),
        "digits": min(9, int(40 * sum(map(text.count, "0123456789")) / chars)),
        "stops": min(9, int(200 * (text.count(".") + text.count(",")) / chars)),
        "signs": min(9, int(60 * sum(map(text.count, ("#", "*", "%", "$", "&", "http"))) / chars)),
        "linebreaks": min(9, int(200 * (len(lines) - 1) / chars)),
        "again": min(9, int(10 * sum(map(operator.eq, words, words[1:])) / max(1, n))),
    }
    return [f"s:{k}:{v}" for k, v in ratios.items()]


def is_training(doc_id: Column, folds: int = 5) -> Column:
    """Rows that labels are learnt from: all but those whose crc32 of the id as text leaves 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, y) of at most ``bound`` labelled training rows, chosen by a hash of the id; null labels and ids are left out.

    The chosen ids are at most ``bound`` rows, so they are broadcast. Of documents that repeat an id one is taken, the one
    whose text has the least hash; they meet within a task before any text is shuffled, so a hot id is a row a task.
    """
    chosen = (
        labels.select("doc_id", label.cast("string").alias("y"))
        .where(F.col("y").isNotNull() & is_training(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"), F.min("y").alias("y"))
    return written(one.select("row.text", "y"), "labelled")


def class_counts(sample: DataFrame) -> dict[str, int]:
    return {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}


def feature_counts(sample: DataFrame, features_of: Callable[[str], set[str]], classes: dict[str, int]) -> DataFrame:
    """(f, and for each class in how many of its rows the feature is), written: several choices are made from it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def rows() -> pd.DataFrame:
            out = [(f, y, n) for y, c in held.items() for f, n in c.items()]
            held.clear()
            return pd.DataFrame(out, columns=["f", "y", "n"])

        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                held.setdefault(y, Counter()).update(features_of(text))
            if sum(map(len, held.values())) > 300_000:
                yield rows()
        if held:
            yield rows()

    return written(sample.mapInPandas(count, "f string, y string, n long").groupBy("f").pivot("y", sorted(classes)).agg(F.sum("n")), "features")


def select_features(counted: DataFrame, classes: dict[str, int], bound: int = MAX_FEATURES, least_z: float = LEAST_Z, always: frozenset[str] = frozenset()) -> list[str]:
    """The features whose document frequency in some class differs most from the rest, and those of ``always`` that occur."""
    total = sum(classes.values())
    seen = sum((F.coalesce(F.col(f"`{y}`"), F.lit(0)) for y in classes), F.lit(0))
    scores = []
    for y, n in classes.items():
        here, all_here = F.coalesce(F.col(f"`{y}`"), F.lit(0)), seen
        rest = F.lit(max(1, total - n))
        a, b = (here + 0.5) / (n + 1), (all_here - here + 0.5) / (rest + 1)
        mean = (all_here + 1.0) / (total + 2)
        scores.append(F.abs(a - b) / F.sqrt(mean * (1 - mean) * (1 / F.lit(max(1, n)) + 1 / rest)))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    rated = counted.select("f", seen.alias("seen"), best.alias("z"))
    top = rated.where((F.col("z") >= least_z) & (F.col("seen") >= 3)).orderBy(F.col("z").desc(), "f").limit(bound).collect()
    kept = {r["f"] for r in top}
    if always:
        kept |= {r["f"] for r in counted.where(F.col("f").isin(*sorted(always))).select("f").collect()}
    return sorted(kept)


class _WordIds(dict):
    """Ids of the selected features of a word; a bounded memory of them."""

    def __init__(self, features: dict[str, int]):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = tuple(self.features[f] for f in word_features(word) if f in self.features)
        return ids


class Indexer:
    """Texts to sorted ids of selected features. Words whose first letters begin no selected feature cost one look-up."""

    def __init__(self, features: list[str], shapes: bool = False):
        self.features = {f: i for i, f in enumerate(features)}
        self.starts = {f[2 : 2 + PREFIXES[0]] for f in features if f[0] in "wp"}
        self.words, self.shapes = _WordIds(self.features), shapes

    def __call__(self, text: str) -> list[int]:
        words = _WORD.findall(text.lower())
        starts, first = self.starts, PREFIXES[0]
        out = set(chain.from_iterable(map(self.words.__getitem__, [w for w in set(words) if w[:first] in starts])))
        if self.shapes:
            out.update(map(self.features.get, shape_features(text, words)))
            out.discard(None)
        return sorted(out)


def features_with(shapes: bool) -> Callable[[str], set[str]]:
    def features(text: str) -> set[str]:
        words = _WORD.findall(text.lower())
        out = {f for w in set(words) for f in word_features(w)}
        if shapes:
            out.update(shape_features(text, words))
        return out

    return features


class Rows:
    """Sparse presence rows, given as the bytes of 32-bit ids."""

    def __init__(self, rows: list[bytes], width: int):
        self.ids = np.frombuffer(b"".join(rows), dtype=np.int32)
        self.at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) // 4 for r in rows])
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.ids], minlength=self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, weights=g[self.at], minlength=self.width)


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 300, tolerance: float = 1e-6, memory: int = 12) -> np.ndarray:
    """The minimum of a convex function, given with its gradient, by limited-memory quasi-Newton steps; it ends where no slope is above ``tolerance``."""
    value, g = f(x)
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(g).max(initial=0.0) <= tolerance:
            break
        d, weights = -g, []
        for s, y in reversed(past):
            weights.append(s @ d / (y @ s))
            d = d - weights[-1] * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.abs(g).sum())
        for (s, y), w in zip(past, reversed(weights), strict=True):
            d = d + (w - y @ d / (y @ s)) * s
        slope, size = g @ d, 1.0
        while True:
            new_value, new_g = f(x + size * d)
            if new_value <= value + 1e-4 * size * slope or size < 1e-9:
                break
            size /= 3
        if new_value >= value:
            break
        s, y = size * d, new_g - g
        if y @ s > 1e-14:
            past.append((s, y))
        x, value, g = x + s, new_value, new_g
    return x


def small_batches(df: DataFrame) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df
