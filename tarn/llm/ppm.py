"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable order with the counts of the bytes that followed. A text's code
length in a language is the sum over its bytes of the bits that the longest known context gives to the byte; a context
that does not know the byte costs an escape to the next shorter one, in which what the longer one knows is excluded
(escape method C). Statistics are frozen once learnt, so that texts are scored alike in any order. The language with
the shortest code wins.

The trees of all languages share one set of contexts. A code length that starts at a shared context is tabulated for
every byte that some language has seen there; any other byte falls back step by step, with the escapes of each step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches, scratch, written

#: Bytes of the longest context.
ORDER = 4
#: Bounds of the fit: texts a language, the most frequent languages, contexts a language; contexts that were seen less often are left out.
MAX_TEXTS = 400
MAX_LANGUAGES = 256
MAX_CONTEXTS = 60_000
LEAST_SEEN = 3
#: A byte that UTF-8 never has stands before the start of a text.
PAD = 0xFF
UNKNOWN = "und"
#: Bytes that are scored at once with up to four languages, with more of them fewer.
SEGMENT = 1 << 18


# -- learning ----------------------------------------------------------------------------------------------------


def is_held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_texts(docs: DataFrame, bound: int = MAX_TEXTS, languages: int = MAX_LANGUAGES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text): of each of the most frequent languages at most ``bound`` distinct texts outside the held-out fold, chosen by a hash of the text.

    Copies of a text meet before they are shuffled, so a hot text or language is a few rows a task; null and empty texts,
    null ids and null languages are not learnt from. The chosen rows are bounded, so they are broadcast.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("k"), docs[f"`{text}`"].alias("text"), docs[f"`{lang}`"].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("k").isNotNull() & (F.col("text") != "") & ~is_held_out(F.col("k"))).withColumn("h", F.xxhash64("text"))
    distinct = written(rows.groupBy("lang", "h").agg(F.min("k").alias("k"), F.count("*").alias("n")), "ppm-candidates")
    frequent = distinct.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).select("lang")
    order = Window.partitionBy("lang").orderBy("h", "k")
    chosen = distinct.join(F.broadcast(frequent), "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= bound)
    chosen = written(chosen.select("lang", "h", "k"), "ppm-chosen")
    return written(rows.join(F.broadcast(chosen), ["lang", "h", "k"]).dropDuplicates(["lang", "h", "k"]).select("lang", "text"), "ppm-texts")


def grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): each byte with the ``order`` bytes before it, the start of the text padded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame([(lang, g, n) for (lang, g), n in counts.items()], columns=["lang", "gram", "n"])
            counts.clear()
            return out

        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                data = bytes([PAD]) * order + t.encode("utf-8", "surrogatepass")
                counts.update((lang, data[i : i + order + 1]) for i in range(len(data) - order))
                if len(counts) > 500_000:
                    yield frame()
        if counts:
            yield frame()

    return texts.mapInPandas(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def context_counts(counted: DataFrame, order: int = ORDER, contexts: int = MAX_CONTEXTS, least: int = LEAST_SEEN) -> DataFrame:
    """(lang, size, context, symbol, n) of the contexts that the trees keep: every suffix of a kept context is kept too.

    The empty context always stays; of the others those seen ``least`` times, at most ``contexts`` a language, the most
    frequent first. A context is seen no more often than its suffix, so with ties by size the kept ones are closed.
    """
    sizes = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("size")
    every = counted.select("lang", sizes, "gram", "n").select("lang", "size", F.substring("gram", order + 1 - F.col("size"), F.col("size")).alias("context"), F.substring("gram", order + 1, 1).alias("symbol"), "n")
    every = written(every.groupBy("lang", "size", "context", "symbol").agg(F.sum("n").alias("n")), "ppm-counts")
    seen = every.groupBy("lang", "size", "context").agg(F.sum("n").alias("seen")).where((F.col("seen") >= least) | (F.col("size") == 0))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("seen").desc(), "size", "context"))
    kept = seen.withColumn("place", place).where(F.col("place") <= contexts).select("lang", "size", "context")
    return every.join(kept, ["lang", "size", "context"])


# -- the model ---------------------------------------------------------------------------------------------------


class Table:
    """A hash table from 64-bit keys to their places, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.shift, self.mask = keys.astype(np.uint64), np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        waiting, at = np.arange(len(keys)), self._home(self.keys)
        while len(waiting):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            placed = first[free[first]]
            self.slots[at[placed]] = waiting[placed]
            rest = np.ones(len(waiting), bool)
            rest[placed] = False
            waiting, at = waiting[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        keys = keys.astype(np.uint64, copy=False)
        at = self._home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slots[at[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return out


def context_key(context: bytes) -> int:
    return int.from_bytes(context, "big") | len(context) << 56


@dataclass
class PpmModel:
    """Per language and shared context, and per language and pair of context and byte, in bits.

    ``escape``: of leaving a context; ``escape_on``: of leaving its suffix then, with what it knows excluded;
    ``hit`` and ``miss``: what the code length from the suffix changes by for that exclusion, where the suffix knows
    the byte and where not. A language that lacks the context passes through it for nothing.
    """

    languages: list[str]
    order: int
    contexts: Table
    parent: np.ndarray
    escape: np.ndarray
    escape_on: np.ndarray
    hit: np.ndarray
    miss: np.ndarray
    last: np.ndarray
    pairs: Table
    bits: np.ndarray
    known: np.ndarray

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (row) in each language (column)."""
        pad = bytes([PAD]) * self.order
        sizes = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
        ends = np.cumsum(sizes + self.order)
        segment = max(4096, 4 * SEGMENT // max(4, len(self.languages)))
        for a in range(0, len(data), segment):
            b = min(a + segment, len(data))
            before = min(a, self.order)
            part = data[a - before : b]
            if before < self.order:
                part = np.concatenate([np.full(self.order - before, PAD, np.uint8), part])
            at = np.arange(a, b)
            owner = np.searchsorted(ends, at, side="right")
            real = at - (ends[owner] - sizes[owner]) >= 0
            bits = self._bits(part, real)
            owner = owner[real]
            if len(owner):
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                total[owner[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        return total

    def _bits(self, data: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Bits of each real byte of ``data``, the first ``order`` bytes of which are only context."""
        history = np.zeros(len(data) - self.order, np.uint64)
        for i in range(self.order):
            history = (history << np.uint64(8)) | data[i : i + len(history)].astype(np.uint64)
        history, symbol = history[real], data[self.order :][real].astype(np.int64)
        node = np.full(len(history), -1, np.int32)
        todo = np.arange(len(history))
        for size in range(self.order, -1, -1):
            masked = (history[todo] & np.uint64((1 << 8 * size) - 1)) | np.uint64(size << 56)
            got = self.contexts.find(masked)
            node[todo] = got
            todo = todo[got < 0]
            if not len(todo):
                break
        pair = self.pairs.find(node.astype(np.int64) << 8 | symbol)
        out = self.bits[pair]
        missed = np.flatnonzero(pair < 0)
        if len(missed):
            out[missed] = self._fallen(node[missed], symbol[missed])
        return out

    def _fallen(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of bytes that no language has seen behind their context: escapes, then the first suffix where one has."""
        out = self.escape[node].copy()
        todo = np.arange(len(node))
        while len(todo):
            child = node[todo]
            up = self.parent[child]
            ended = up < 0
            out[todo[ended]] += self.last
            todo, child, up = todo[~ended], child[~ended], up[~ended]
            pair = self.pairs.find(up.astype(np.int64) << 8 | symbol[todo])
            found = pair >= 0
            p, c = pair[found], child[found]
            out[todo[found]] += self.bits[p] + np.where(self.known[p], self.hit[c], self.miss[c])
            out[todo[~found]] += self.escape_on[child[~found]]
            node[todo] = up
            todo = todo[~found]
        return out


def build(rows: list[tuple[str, bytes, int, int]], order: int = ORDER) -> PpmModel:
    """The tables of (language, context, symbol, count) rows whose contexts are closed under suffixes."""
    languages = sorted({r[0] for r in rows})
    trees: list[dict[bytes, dict[int, int]]] = [{} for _ in languages]
    place = {lang: i for i, lang in enumerate(languages)}
    for lang, context, symbol, n in rows:
        trees[place[lang]].setdefault(context, {})[symbol] = n
    contexts = sorted({c for t in trees for c in t}, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(contexts)}
    parent = np.array([number[c[1:]] if c else -1 for c in contexts], np.int32)
    shape = (len(contexts), len(languages))
    escape, escape_on, hit, miss = (np.zeros(shape) for _ in range(4))
    log = np.log2
    for li, tree in enumerate(trees):
        total = {c: sum(s.values()) for c, s in tree.items()}
        for i, c in enumerate(contexts):
            own = tree.get(c)
            if own is not None:
                escape[i, li] = log((total[c] + len(own)) / len(own))
            if not c:
                continue
            suffix = tree.get(c[1:])
            if suffix is None:
                continue
            up = total[c[1:]] + len(suffix)
            leave = log(up / len(suffix))
            if own is None:
                escape_on[i, li] = leave
                continue
            left = len(suffix) - len(own)
            rest = total[c[1:]] - sum(suffix[s] for s in own) + left
            escape_on[i, li] = log(rest / left) if left else 0.0
            hit[i, li] = log(rest / up) if left else 0.0
            miss[i, li] = escape_on[i, li] - leave
    last = np.array([log(max(1, 256 - len(t[b""]))) for t in trees])
    pair_key, bits, known = [], [], []
    at: dict[tuple[bytes, int], int] = {}
    for i, c in enumerate(contexts):
        for s in sorted({s for t in trees if c in t for s in t[c]}):
            row, has = np.empty(len(languages)), np.zeros(len(languages), bool)
            for li, tree in enumerate(trees):
                own = tree.get(c)
                if own is not None and s in own:
                    row[li], has[li] = escape[i, li] + log(len(own) / own[s]), True
                elif not c:
                    row[li] = escape[i, li] + last[li]
                else:
                    # A suffix has the bytes of its extensions, in whichever language it has them.
                    up = at[c[1:], s]
                    row[li] = escape[i, li] + bits[up][li] + (hit[i, li] if known[up][li] else miss[i, li])
            at[c, s] = len(pair_key)
            pair_key.append(i << 8 | s)
            bits.append(row)
            known.append(has)
    none = np.empty((0, len(languages)))
    return PpmModel(
        languages, order, Table(np.array([context_key(c) for c in contexts], np.uint64)), parent, escape, escape_on, hit, miss, last,
        Table(np.array(pair_key, np.uint64)), np.array(bits) if bits else none, np.array(known) if known else none.astype(bool),
    )


def fit(docs: DataFrame, texts: int = MAX_TEXTS, contexts: int = MAX_CONTEXTS, order: int = ORDER, key: str = "doc_id", text: str = "text", lang: str = "lang") -> PpmModel | None:
    """Learns from at most ``texts`` distinct texts a language and keeps at most ``contexts`` contexts a language; None without any.

    What reaches the driver are the counts of the kept contexts.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        got = context_counts(grams(training_texts(docs, texts, key=key, text=text, lang=lang), order), order, contexts).select("lang", "context", "symbol", "n").toArrow().to_pylist()
    rows = [(r["lang"], r["context"], r["symbol"][0], r["n"]) for r in got]
    return build(rows, order) if rows else None


# -- prediction --------------------------------------------------------------------------------------------------


def posterior(lengths: np.ndarray) -> np.ndarray:
    """Of each language, all being equally likely beforehand, given the code lengths of one text."""
    e = np.exp2(lengths.min(axis=-1, keepdims=True) - lengths)
    return e / e.sum(axis=-1, keepdims=True)


def predict(docs: DataFrame, model: PpmModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the posterior of the prediction) and bits (a byte, in the predicted language).

    Whole texts, each by itself; languages with equal code lengths are taken in alphabetical order. Null texts and those
    without any letter are ``und`` with score 0 and no bits, and so are all if nothing was learnt. A null id is not held
    out; repeated rows stay; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, bits = [UNKNOWN] * n, [0.0] * n, [None] * n
            texts = batch.column(1).to_pylist()
            asked = [i for i in range(n) if m is not None and texts[i] is not None]
            if asked:
                lengths = m.code_lengths([texts[i] for i in asked])
                best, chance = lengths.argmin(axis=1), posterior(lengths)
                for row, i in enumerate(asked):
                    lang[i], score[i] = m.languages[best[row]], float(chance[row, best[row]])
                    bits[i] = float(lengths[row, best[row]] / len(texts[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["k", "lang_pred", "score", "bits"])

    content = F.when(F.rlike(docs[f"`{text}`"], F.lit(r"\p{L}")), docs[f"`{text}`"].cast("binary"))
    out = docs.select(docs[f"`{key}`"].alias("k"), content.alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, bits double")
    return out.select(F.col("k").alias("doc_id"), is_held_out(F.col("k")).alias("held_out"), "lang_pred", "score", "bits")
