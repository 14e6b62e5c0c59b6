"""Document fingerprints from spot signatures: chains of content words behind common-word anchors.

A fingerprint is the sorted set of 32-bit signature hashes, in base64. Sets are compared by their Jaccard
likeness; a join partitions them by size and prunes pairs that cannot reach the threshold.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches

#: Common words that open a chain, of four languages; so do the start of a text, the ends of its sentences and lines, and bars.
ANCHORS = frozenset(".!?|\n") | frozenset(
    """the a an of and or to in on at by is are was were be been it that this for with as from not but have has had
    der die das den dem des ein eine einer und oder zu von mit auf ist nicht für im sich bei aus nach wie
    le la les du de un une et ou que qui dans pour par sur est pas au aux avec ce il elle son
    el los las del y en una con se lo como su al no es""".split()
)
#: Content words in a chain.
CHAIN = 2
CACHED_WORDS = 500_000
_WORD = re.compile(r"\w+|[.!?|\n]")
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Spots:
    """Signature sets of texts; holds a bounded cache of word hashes."""

    def __init__(self, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN):
        self.anchors, self.chain = anchors, chain
        self.cache: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        """64 bits; the lowest tells an anchor."""
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ~1 | (word in self.anchors)
        self.cache[word] = h
        return h

    @staticmethod
    def _folded(parts: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(parts[0]), dtype=np.uint64)
        for p, m in zip(parts, np.resize(_MIX, len(parts)), strict=True):
            h = (h ^ p) * m
            h ^= h >> np.uint64(29)
        h *= _MIX[0]
        return (h >> np.uint64(32)).astype(np.uint32)

    def signatures(self, text: str) -> np.ndarray:
        """Sorted distinct signatures: of each anchor with a word behind it, and of the start; a chain that the text's end cuts ends in a mark.

        Empty text: none. A text without any word has one, of its characters.
        """
        cache, own = self.cache, self._hash
        h = np.array([cache.get(w) or own(w) for w in _WORD.findall(text.lower())], dtype=np.uint64)
        is_anchor = (h & np.uint64(1)).astype(bool)
        content = np.flatnonzero(~is_anchor)
        if not len(content) and not is_anchor.any():
            return np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")] if text else [], dtype=np.uint32)
        words = np.concatenate([h[content], np.full(self.chain, _END)])
        at = np.flatnonzero(is_anchor)
        first = np.concatenate([[0], np.searchsorted(content, at)])
        anchor = np.concatenate([[_START], h[at]])
        fits = first < max(1, len(content))
        return np.unique(self._folded([anchor[fits]] + [words[first[fits] + k] for k in range(self.chain)]))


def packed(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def half_edited(text: str, donor: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``donor``."""
    h = len(text) // 2
    return text[: len(text) - h] + donor[:h]


_SPOTS: dict[str, Spots] = {}


def spots() -> Spots:
    return _SPOTS.setdefault("default", Spots())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, n_signatures) of every row; null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = spots()
        for b in batches:
            sets = [s.signatures(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(x) for x in sets], pa.string()), pa.array([len(x) for x in sets], pa.int64())], ["k", "fingerprint", "n_signatures"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, f"k {kind}, fingerprint string, n_signatures long").withColumnRenamed("k", key)


def id_ranges(docs: DataFrame, key: str, ranges: int) -> list[int]:
    """Ascending bounds that cut the ids into about equal ranges; at most ``ranges`` numbers reach the driver."""
    shares = [i / ranges for i in range(1, ranges)]
    row = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)) if shares else F.array(F.lit(0.5)), F.lit(max(10_000, 4 * ranges))).alias("cuts")).first()
    return sorted({int(x) for x in row["cuts"] or []}) if shares else []


def hot_ids(rows: DataFrame) -> dict[int | None, int]:
    """Ids (null too) with more rows than an even share of a shuffle partition, and into how many parts those are split; at most one id a partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    found = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > max(64, total / parts)).collect()
    return {r["k"]: math.ceil(r["n"] * parts / total) for r in found}


def with_next(docs: DataFrame, run, schema: str, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Calls ``run(iterator of (key, text, next text))`` over all rows in descending order of the key; ``run`` yields Arrow batches.

    The text after the last row's is the first row's. Null keys come last; rows with equal keys are in order of a hash
    of their texts, then of the texts. The rows are cut into ranges (at most 20,000 and the parts of hot keys) that are
    streamed in order by one task each; a key with very many rows, null too, is cut by the texts' hashes. A range's last
    row looks ahead to one row that is sent along from the next range, so nothing is gathered.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    hot = hot_ids(keyed)
    own = {x for k in hot if k is not None for x in (k - 1, k) if x >= -(1 << 63)}
    cuts = np.array(sorted({*id_ranges(docs, key, ranges or min(20_000, 6 * parts)), *own}), dtype=np.int64)

    def number(keys: pd.Series) -> pd.Series:
        """Range 0 has the largest ids."""
        return pd.Series(len(cuts) - np.searchsorted(cuts, keys.to_numpy(), side="left")).astype("int64")

    # The null ids' range is the last one; the function only sees numbers, which stay whole.
    range_of = F.when(F.col("k").isNull(), F.lit(len(cuts) + 1)).otherwise(F.pandas_udf(number, "long")(F.coalesce("k", F.lit(0))))
    of_key = F.create_map(*(F.lit(x).cast("long") for k, n in hot.items() if k is not None for x in (k, n))) if hot.keys() - {None} else None
    pieces = F.when(F.col("k").isNull(), F.lit(hot.get(None, 1))).otherwise(F.lit(1) if of_key is None else F.coalesce(of_key[F.col("k")], F.lit(1)))
    piece = F.least(pieces - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * pieces))
    rows = keyed.withColumn("r", range_of * (1 << 32) + piece)
    first = F.min(F.struct(F.col("k").isNull().alias("none"), F.bitwise_not("k").alias("falling"), "h")).alias("x")
    heads = sorted(rows.groupBy("r").agg(first).select("r", F.bitwise_not("x.falling").alias("k"), "x.h").collect(), key=lambda x: x["r"])
    before = [(heads[i - 1]["r"], x["k"], x["h"]) for i, x in enumerate(heads)]
    ahead = F.broadcast(spark.createDataFrame(before, "to long, head long, head_h long"))
    extra = rows.join(ahead, rows["k"].eqNullSafe(ahead["head"]) & (rows["h"] == ahead["head_h"])).groupBy("to", "k", "h").agg(F.min("t").alias("t")).select("k", "t", "h", F.col("to").alias("r"), F.lit(True).alias("extra"))
    dealt = rows.withColumn("extra", F.lit(False)).unionByName(extra).repartition(parts, "r").sortWithinPartitions("r", "extra", F.col("k").desc_nulls_last(), "h", "t")

    def pairs(batches: Iterator[pa.RecordBatch]):
        waiting = None
        for b in batches:
            for k, t, extra in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if waiting is not None:
                    yield waiting[0], waiting[1], t
                waiting = None if extra else (k, t)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pairs(batches))

    return dealt.select("k", "t", "extra").mapInArrow(go, schema)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The edited text is ``half_edited`` with the next document's. Null texts count as empty; repeated rows stay. Null ids
    come last, and rows with equal ids in order of their texts' hashes, so which of them is next to which is fixed; other
    columns are not looked at, and an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64())])

    def run(rows) -> Iterator[pa.RecordBatch]:
        s, out = spots(), []
        ahead_text, ahead = None, None
        for k, t, donor in rows:
            own = ahead if ahead_text is not None and ahead_text == t else s.signatures(t)
            edited = half_edited(t, donor)
            e, d = s.signatures(edited), s.signatures(donor)
            ahead_text, ahead = donor, d
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((k, len(t), digest, packed(own), packed(e), likeness(own, e), likeness(own, d), len(own)))
            if len(out) >= 500:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long", key, text)


def near_pairs(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Pairs of distinct fingerprints with likeness of at least ``threshold``: (a, b, likeness) between class representatives.

    ``prints`` has the key, fingerprint and n_signatures. Rows with equal fingerprints are one class, whose
    smallest key stands for it. Sets are partitioned by length so that only lengths that can reach the threshold
    meet; within a partition sets meet on the signatures of their rarest-first prefix. Empty sets have no pair.
    """
    classes = prints.where("n_signatures > 0").groupBy("fingerprint").agg(F.min(key).alias("id"))
    ratio = float(1 / threshold)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sig = [], []
            for i, f in zip(b["id"], b["fingerprint"], strict=True):
                s = unpacked(f)
                ids += [i] * len(s)
                sig += s.tolist()
            yield pd.DataFrame({"id": ids, "sig": sig}, dtype="int64")

    counts = classes.mapInPandas(rows, "id long, sig long").groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    # Only signatures that two classes share can link them; the prefix is taken over all of a set, rarest first.
    spread = classes.mapInPandas(rows, "id long, sig long").join(counts, "sig", "left")
    sets = spread.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "sig"))).alias("set"))
    sized = sets.withColumn("size", F.size("set"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold) + 1
    prefix = sized.select("id", "size", F.explode(F.slice("set", F.lit(1), keep.cast("int"))).alias("s")).where("s.n > 1").select("id", "size", F.col("s.sig").alias("sig"))
    part = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(ratio)))
    left = prefix.withColumn("part", F.explode(F.array(part, part + 1)))
    right = prefix.withColumn("part", part)
    l, r = left.alias("l"), right.alias("r")
    lower = (F.col("l.size") < F.col("r.size")) | ((F.col("l.size") == F.col("r.size")) & (F.col("l.id") < F.col("r.id")))
    met = l.join(r, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.part") == F.col("r.part")) & lower & (F.col("l.size") >= threshold * F.col("r.size")))
    pairs = met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("set.sig").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set.sig").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    like = both / (F.size("sa") + F.size("sb") - both)
    return with_sets.select("a", "b", like.alias("likeness")).where(F.col("likeness") >= threshold)
