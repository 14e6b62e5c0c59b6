"""N-gram Jaccard join over a token-group matrix.

Distinct shingle sets that share a token of their rarest-first prefixes (only such sets can reach the threshold)
are partitioned into groups around the most widely shared of those tokens. Each group is a row of the token-group
matrix: the union of its members' tokens. A query set is tested against the row first; only where the overlap
bound can reach the threshold is the group opened and the query compared with its members. Groups beyond
``UNIT`` members are split into units of bounded size, after a comparison of every member with one central set.

A token is a 64-bit hash of a shingle, made of keyed hashes of its words, and a set is named by 128 bits of a digest
of its tokens. Before a link between sets of different names counts, their shingles are compared word by word.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches, hot_keys, salted_join, scratch, shared_folder, written

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members, and queries, that meet in one unit of work.
UNIT = 64
#: The largest set of a group is at most so many times as large as the smallest.
GROUP_SPREAD = 1.06
#: So many of the most frequent tokens have their document frequency known; it orders the prefixes and bounds what is broadcast (16 bytes each). The result does not depend on it.
FREQUENT_TOKENS = 65_536
LEAST_FREQUENCY = 10
#: Tokens that a task holds to count them.
HELD_TOKENS = 2_000_000

_ODD = np.random.default_rng(20240501).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = b"tarn n-gram words"
#: Words whose hashes a worker remembers.
CACHED_WORDS = 250_000


class _WordHashes(dict):
    """Keyed 64-bit hashes of words; a bounded memory of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; words apart by the space and U+0009 to U+000D, which is what bytes split at."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit tokens; fewer words than ``words`` make one token, none no token."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(words, len(word))
    n = len(word) - k + 1
    h = word[:n] * _ODD[0] + np.uint64(k)
    for i in range(1, k):
        h += word[i : i + n] * _ODD[i]
    h = _mix(h)
    h.sort()
    if (again := h[1:] == h[:-1]).any():
        h = h[np.concatenate([[True], ~again])]
    return h


def real_shingles(text: str, words: int = WORDS) -> frozenset[tuple[bytes, ...]]:
    """The set itself, without any hash of ours."""
    found = words_of(text)
    k = min(words, len(found))
    return frozenset(zip(*(found[i : len(found) - k + 1 + i] for i in range(k)), strict=True)) if k else frozenset()


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    a, b = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def needed(size: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of ``size`` must have with a partner."""
    return -(-percent * size // 100)


def linked(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


# -- scans -------------------------------------------------------------------------------------------------------


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_name(key: Column, h: Column) -> Column:
    """What tells rows of unlike texts apart, whether or not they share an id or have none."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), h.cast("string"))


def sketch(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One pass: (doc_id, h, n, s1, s2) of every row, ``h`` a hash of its text, and (token, df) partial counts of tokens that recur within a task."""
    spark = docs.sparkSession
    path = shared_folder(spark, "ngram-sketch")
    kind = dict(docs.dtypes)[key]
    schema = pa.schema([("kind", pa.int32()), ("k", pa.string()), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0

        def recurring() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.nulls(len(token), pa.string()), pa.nulls(len(token), pa.int64()), pa.array(count.astype(np.int64)), pa.array(token.view(np.int64)), pa.nulls(len(token), pa.int64())], schema=schema)

        for batch in batches:
            n, s1, s2 = [], [], []
            for t in batch.column(2):
                tokens = shingles(t.as_py() or "")
                s = signature(tokens)
                n.append(len(tokens))
                s1.append(s[0])
                s2.append(s[1])
                if s not in seen and len(tokens):
                    seen.add(s)
                    held.append(tokens)
                    size += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], schema=schema)
            if size > HELD_TOKENS:
                yield recurring()
                held, size = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield recurring()

    rows = docs.select(F.col(key).cast("string").alias("k"), text_hash(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, "kind int, k string, h long, n long, s1 long, s2 long")
    rows.write.partitionBy("kind").parquet(path)
    back = spark.read.schema("k string, h long, n long, s1 long, s2 long, kind int").parquet(path)
    return back.where("kind = 0").select(F.col("k").cast(kind).alias("doc_id"), "h", "n", "s1", "s2"), back.where("kind = 1").select(F.col("s1").alias("token"), F.col("n").alias("df"))


def frequent_tokens(counts: DataFrame, bound: int = FREQUENT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``bound`` tokens, sorted, and the frequencies that order them."""
    rows = counts.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= LEAST_FREQUENCY).orderBy(F.col("df").desc(), "token").limit(bound).collect()
    token = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
    df = np.array([r["df"] for r in rows], dtype=np.int64)
    order = np.argsort(token)
    return token[order], df[order]


def prefix_of(tokens: np.ndarray, frequent: np.ndarray, df: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The first n - needed(n) + 1 tokens (and their known frequencies, else 0) in the global order: unknown ones by value, then by frequency."""
    size = len(tokens) - needed(len(tokens), percent) + 1
    if not len(frequent):
        return tokens[:size], np.zeros(min(size, len(tokens)), np.int64)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    known = frequent[at] == tokens
    rare = tokens[~known]
    if len(rare) >= size:
        return rare[:size], np.zeros(size, np.int64)
    at = at[known]
    at = at[np.lexsort((at, df[at]))][: size - len(rare)]
    return np.concatenate([rare, frequent[at]]), np.concatenate([np.zeros(len(rare), np.int64), df[at]])


def shared_postings(docs: DataFrame, text: str, frequent: np.ndarray, df: np.ndarray) -> DataFrame:
    """(token, df, n, s1, s2): prefix tokens that stand in the prefixes of two or more distinct sets whose sizes allow a link.

    Tokens of known frequency are shared by their count and are dealt by set, so a very common one fills no single
    task; the others are dealt by token and passed in order of size, each row compared with its neighbours, which
    are nearest in size.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((frequent, df))
    schema = pa.schema([("token", pa.int64()), ("df", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
    ddl = "token long, df long, n int, s1 long, s2 long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = table.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            token, freq, n, s1, s2 = [], [], [], [], []
            for t in batch.column(0):
                tokens = shingles(t.as_py() or "")
                s = signature(tokens)
                if not len(tokens) or s in seen:
                    continue
                seen.add(s)
                p, f = prefix_of(tokens, known, counts)
                token.append(p)
                freq.append(f)
                n.append(np.full(len(p), len(tokens), np.int32))
                s1.append(np.full(len(p), s[0], np.int64))
                s2.append(np.full(len(p), s[1], np.int64))
            if len(seen) > 1_000_000:
                seen.clear()
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(freq)), pa.array(np.concatenate(n)), pa.array(np.concatenate(s1)), pa.array(np.concatenate(s2))], schema=schema)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None  # the last distinct row, and whether its token has been seen in another set
        flag = False

        def out(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], schema=schema)

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if carried is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(carried, cols, strict=True)]
            if not len(cols[0]):
                continue
            token, freq, n, s1, s2 = cols
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            cols = [c[new] for c in cols]
            token, freq, n = cols[0], cols[1], cols[2].astype(np.int64)
            same = (token[1:] == token[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
            share = freq > 0
            share[1:] |= same
            share[:-1] |= same
            share[0] |= flag and carried is not None
            yield out(cols, np.flatnonzero(share[:-1]))
            carried, flag = [c[-1:] for c in cols], bool(share[-1])
        if carried is not None and flag:
            yield out(carried, np.array([0]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.select(F.col(text).alias("t")).mapInArrow(emit, ddl)
    dealt = postings.repartition(parts, F.when(F.col("df") > 0, F.xxhash64("token", "s1")).otherwise(F.col("token"))).sortWithinPartitions("token", "n", "s1", "s2")
    return written(dealt.mapInArrow(neighbours, ddl), "ngram-postings")


# -- groups ------------------------------------------------------------------------------------------------------


def group_name(token: Column, n: Column) -> Column:
    """Sets around one token and of about one size: the narrower a group's sizes, the sharper the bound on what it can share."""
    return F.xxhash64(token, size_class(n))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(GROUP_SPREAD))).cast("int")


#: Classes of sizes that can link are at most so far apart.
CLASSES_APART = math.ceil(math.log(100 / PERCENT) / math.log(GROUP_SPREAD)) + 1


def least_shared(small: Column, large: Column) -> Column:
    """How many prefix tokens two linked sets at least share, for sizes within [small, large].

    Two sets of sizes n >= m link only with an overlap of 4 (n + m) / 9. Behind the shorter prefix, in the global
    order, at most 0.8 n tokens are left, so the rest lies in both prefixes. Two tokens are allowed for rounding.
    """
    share = PERCENT / (100 + PERCENT)
    return F.greatest(F.lit(1.0), share * small - (PERCENT / 100 - share) * large - 2)


def token_groups(postings: DataFrame, grouped: DataFrame) -> DataFrame:
    """The prefix part of the token-group matrix: (token, g, size_class, members)."""
    named = grouped.select("s1", "s2", "g", size_class(F.col("n")).alias("size_class"))
    return written(postings.select("token", "s1", "s2").join(named, ["s1", "s2"]).groupBy("token", "g", "size_class").agg(F.count("*").alias("members")), "ngram-matrix")


#: A matrix row meets those before it, is met by those behind it, or both.
MEETS, IS_MET, BOTH = 0, 1, 2


def group_pairs(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (g, h), g <= h, of groups whose rows share so many prefix tokens that members can link; (g, g) if members of one group can.

    The groups of a token pass in order of their sizes, and each meets those before it that are near enough in size.
    Where a token has very many groups they are dealt to several tasks, and each of these sees all of them go by.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run, found = None, deque(), Counter()

        def frame() -> pd.DataFrame:
            df = pd.DataFrame([(g, h, n) for (g, h), n in found.items()], columns=["g", "h", "shared"], dtype="int64")
            found.clear()
            return df

        for b in batches:
            for t, salt, c, g, role in zip(*(b[x].tolist() for x in ("token", "salt", "size_class", "g", "role")), strict=True):
                if (t, salt) != key:
                    key = t, salt
                    run.clear()
                while run and run[0][0] < c - CLASSES_APART:
                    run.popleft()
                if role != IS_MET:
                    found.update((min(o, g), max(o, g)) for _, o in run)
                if role != MEETS:
                    run.append((c, g))
                if len(found) > 100_000:
                    yield frame()
        if found:
            yield frame()

    parts = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = matrix.select("token", "size_class", "g")
    hot = hot_keys(rows, ["token"])
    if hot is None:
        dealt = rows.select("*", F.lit(0).alias("salt"), F.lit(BOTH).alias("role"))
    else:
        salted = rows.join(F.broadcast(hot), "token", "left")
        one = salted.where("salts IS NULL").select("token", "size_class", "g", F.lit(0).alias("salt"), F.lit(BOTH).alias("role"))
        several = salted.where("salts IS NOT NULL")
        meets = several.select("token", "size_class", "g", F.pmod(F.xxhash64("g"), F.col("salts")).cast("int").alias("salt"), F.lit(MEETS).alias("role"))
        met = several.select("token", "size_class", "g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(IS_MET).alias("role"))
        dealt = one.unionByName(meets).unionByName(met)
    dealt = dealt.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "size_class", "g", "role")
    cross = dealt.mapInPandas(pairs, "g long, h long, shared long").groupBy("g", "h").agg(F.sum("shared").alias("shared"))
    own = matrix.where("members > 1").groupBy("g").agg(F.count("*").alias("shared")).select("g", F.col("g").alias("h"), "shared")
    size = groups.select("g", "n_min", "n_max")
    sized = cross.unionByName(own).join(size, "g").join(size.select(F.col("g").alias("h"), F.col("n_min").alias("h_min"), F.col("n_max").alias("h_max")), "h")
    fits = (100 * F.col("n_max") >= PERCENT * F.col("h_min")) & (100 * F.col("h_max") >= PERCENT * F.col("n_min"))
    return written(sized.where(fits & (F.col("shared") >= least_shared(F.least("n_min", "h_min"), F.greatest("n_max", "h_max")))).select("g", "h"), "ngram-pairs")


def _jaccard_links(left: pd.Series, right: pd.Series) -> pd.Series:
    out, last, last_tokens, last_real = [], None, None, None
    for a, b in zip(left, right, strict=True):
        if b != last:
            last, last_tokens, last_real = b, shingles(b), real_shingles(b)
        t = shingles(a)
        both = len(np.intersect1d(t, last_tokens, assume_unique=True))
        out.append(linked(both, len(t), len(last_tokens)) and really_linked(real_shingles(a), last_real))
    return pd.Series(out, dtype=bool)


def really_linked(a: frozenset, b: frozenset) -> bool:
    return linked(len(a & b), len(a), len(b))


def links_to(text: Column, other: Column) -> Column:
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return _jaccard_links(a, b)

    return F.pandas_udf(f, "boolean")(text, other)


class Unit:
    """Members of a group (or of one unit of a large group) with their row of the token-group matrix."""

    def __init__(self, sets: list[np.ndarray], connected: list[bool]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], self.owner[order]
        self.row = np.unique(tokens)
        self.connected = np.array(connected, dtype=bool)

    def bound(self, query: np.ndarray) -> int:
        """At most so many tokens can any member share with the query."""
        if not len(self.row):
            return 0
        at = np.minimum(np.searchsorted(self.row, query), len(self.row) - 1)
        return int((self.row[at] == query).sum())

    def opened(self, query: np.ndarray) -> np.ndarray:
        """Members that link with the query; the group is opened only if the bound allows a link."""
        if self.bound(query) < needed(len(query)):
            return np.empty(0, np.int64)
        lo, hi = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        spans = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sets))
        return np.flatnonzero(100 * both >= PERCENT * (len(query) + self.sizes - both))


def unit_links(members: list[tuple], queries: list[tuple], whole: bool) -> list[tuple[int, int, int, int]]:
    """Links within one unit, as far as they connect: between queries and members, and between members where the unit is a whole group.

    Members are (s1, s2, star, text); of the star ones, which are known to be connected, one link is enough.
    """
    unit = Unit([shingles(m[3]) for m in members], [m[2] for m in members])
    out, root, real = [], {}, {}

    def words(s: tuple) -> frozenset:
        if s[:2] not in real:
            real[s[:2]] = real_shingles(s[3])
        return real[s[:2]]

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def visit(s: tuple, tokens: np.ndarray, skip: int = -1) -> None:
        joined = False  # to one of the star
        for i in unit.opened(tokens):
            star = unit.connected[i]
            a, b = top(s[:2]), top(members[i][:2])
            if i <= skip or a == b or star and joined or not really_linked(words(s), words(members[i])):
                continue
            root[a] = b
            joined |= star
            out.append((*s[:2], *members[i][:2]))

    if whole:
        for i, t in enumerate(unit.sets):
            visit(members[i], t, i)
    for q in queries:
        visit(q, shingles(q[3]))
    return out


def all_unit_links(units: DataFrame) -> DataFrame:
    """``unit_links`` of each (to, unit, chunk). A task streams its units in order and holds one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sets, whole, out = None, ({}, {}), False, []

        def frame() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=["a1", "a2", "b1", "b2"], dtype="int64")
            out.clear()
            return df

        for b in batches:
            for *k, role, star, w, s1, s2, text in zip(*(b[c].tolist() for c in (*_UNIT_COLUMNS, "text")), strict=True):
                if k != key:
                    if sets[0] and (sets[1] or whole):
                        out += unit_links(list(sets[0].values()), list(sets[1].values()), whole)
                    key, sets, whole = k, ({}, {}), False
                sets[role][s1, s2] = (s1, s2, star, text)
                whole |= w
            if out:
                yield frame()
        if sets[0] and (sets[1] or whole):
            out += unit_links(list(sets[0].values()), list(sets[1].values()), whole)
        if out:
            yield frame()

    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select(*_UNIT_COLUMNS, "text").repartition(parts, "to", "unit", "chunk").sortWithinPartitions("to", "unit", "chunk")
    return dealt.mapInPandas(run, "a1 long, a2 long, b1 long, b2 long")


def active_texts(docs: DataFrame, key: str, text: str, sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """(s1, s2, text) of the sets that are in groups, each once.

    A text is taken from the row that stands for its set, known by its id and its text's hash, so that rows that share
    an id or have none meet their own set alone, and it is checked by the set's name. Rows that repeat both are as good
    as each other: very many of them are dealt to several tasks, and one is taken.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [signature(shingles(t)) == (x, y) for t, x, y in zip(b["text"], b["s1"], b["s2"], strict=True)]
            yield b[keep]

    wanted = grouped.join(sets.select("s1", "s2", "name", "repeats"), ["s1", "s2"]).select("s1", "s2", "name", "repeats")
    texts = docs.select(row_name(F.col(key), text_hash(text)).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    once, again = wanted.where("repeats = 1"), written(wanted.where("repeats > 1"), "ngram-repeated")
    found = texts.join(once, "name").select("s1", "s2", "text")
    if not again.isEmpty():
        dealt = salted_join(texts.withColumn("i", F.monotonically_increasing_id()), again, ["name"], ["i"], hot=hot_keys(again, ["name"], "repeats"))
        found = found.unionByName(dealt.groupBy("s1", "s2").agg(F.min("text").alias("text")))
    return written(found.mapInPandas(check, "s1 long, s2 long, text string"), "ngram-texts")


def find_links(texts: DataFrame, members: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """All links that connect components, as (a1, a2, b1, b2).

    ``members`` has s1, s2, g; ``groups`` has g, size and the central set (c1, c2) of each group. Of a pair of
    groups, the members of the smaller one are queries to the larger. In a group of more than ``UNIT`` members every
    member and every query is first compared with the central set; what links with it is connected through it, and
    only what does not visits all of the group's units, in chunks of bounded size. Units are planned over names of
    sets alone; texts join them at the end.
    """
    size = groups.select("g", "size")
    large_groups = hot_keys(groups, ["g"], "size")
    sided = pairs.where("g <> h").join(size, "g").join(size.select(F.col("g").alias("h"), F.col("size").alias("size_h")), "h")
    from_g = F.col("size") < F.col("size_h")
    visits = sided.select(F.when(from_g, F.col("g")).otherwise(F.col("h")).alias("g"), F.when(from_g, F.col("h")).otherwise(F.col("g")).alias("to"))
    own = members.select("s1", "s2", "g", F.col("g").alias("to"), F.lit(True).alias("own"))
    cross = salted_join(members, visits, ["g"], ["s1", "s2"], hot=large_groups).select("s1", "s2", "g", "to", F.lit(False).alias("own"))
    plan = written(own.unionByName(cross), "ngram-visits")
    visited = hot_keys(plan, ["to"])
    everyone = written(salted_join(plan, groups.select(F.col("g").alias("to"), "size", "c1", "c2"), ["to"], ["s1", "s2"], hot=visited).drop("g"), "ngram-visits")
    large = everyone.where(F.col("size") > UNIT)
    central = groups.where(F.col("size") > UNIT).select(F.col("g").alias("to"), F.col("c1").alias("s1"), F.col("c2").alias("s2")).join(texts, ["s1", "s2"]).select("to", F.col("text").alias("central"))
    met = written(salted_join(large.join(texts, ["s1", "s2"]), central, ["to"], ["s1", "s2"], hot=visited).withColumn("near", links_to(F.col("text"), F.col("central"))).drop("central", "text"), "ngram-central")
    star = met.where("near AND NOT (s1 = c1 AND s2 = c2)").select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
    units = small_units(everyone.where(F.col("size") <= UNIT), visited).unionByName(large_units(met, visited)).join(texts, ["s1", "s2"])
    return all_unit_links(units).unionByName(star)


_UNIT_COLUMNS = ["to", "unit", "chunk", "role", "star", "whole", "s1", "s2"]


def _slot(n: Column) -> Column:
    return F.pmod(F.xxhash64("s1", "s2"), n).cast("int")


def small_units(rows: DataFrame, visited: DataFrame | None) -> DataFrame:
    """A group of at most UNIT members is one unit, repeated for each chunk of its queries; the first chunk also compares the members."""
    counts = rows.where("NOT own").groupBy("to").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("chunks"))
    rows = rows.where("size > 1 OR NOT own").unionByName(rows.where("size = 1 AND own").join(counts.select("to"), "to", "left_semi"))
    rows = written(salted_join(rows, counts, ["to"], ["s1", "s2"], "left", visited).select("s1", "s2", "to", "own", F.coalesce("chunks", F.lit(1)).alias("chunks")), "ngram-small")
    members = rows.where("own").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.withColumn("role", F.lit(0)).withColumn("whole", F.col("chunk") == 0)
    queries = rows.where("NOT own").withColumn("chunk", _slot(F.col("chunks"))).withColumn("role", F.lit(1)).withColumn("whole", F.lit(False))
    return members.unionByName(queries).withColumn("unit", F.lit(0)).withColumn("star", F.lit(False)).select(*_UNIT_COLUMNS)


def large_units(met: DataFrame, visited: DataFrame | None) -> DataFrame:
    """Units of large groups: members near the central set, and the others. What is near it visits only the others, unless it is a member itself."""
    at_least = lambda c: F.greatest(F.ceil(c / UNIT), F.lit(1)).cast("int")
    counts = met.groupBy("to").agg(
        F.count_if(F.col("own") & F.col("near")).alias("n_near"),
        F.count_if(F.col("own") & ~F.col("near")).alias("n_far"),
        F.count_if(~F.col("near")).alias("far_visits"),
        F.count_if(~F.col("near") | ~F.col("own")).alias("all_visits"),
    )
    sized = counts.select("to", at_least(F.col("n_near")).alias("near_units"), F.ceil(F.col("n_far") / UNIT).cast("int").alias("far_units"), F.ceil(F.col("far_visits") / UNIT).cast("int").alias("near_chunks"), F.ceil(F.col("all_visits") / UNIT).cast("int").alias("far_chunks"))
    rows = written(salted_join(met, sized, ["to"], ["s1", "s2"], hot=visited).drop("size", "c1", "c2"), "ngram-large")
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    near = rows.where("own AND near").withColumn("unit", _slot(F.col("near_units"))).withColumn("chunk", F.explode(span(F.col("near_chunks"))))
    far = rows.where("own AND NOT near").withColumn("unit", F.col("near_units") + _slot(F.greatest("far_units", F.lit(1)))).withColumn("chunk", F.explode(span(F.col("far_chunks"))))
    members = near.unionByName(far).withColumn("role", F.lit(0))
    to_near = rows.where("NOT near").withColumn("chunk", _slot(F.greatest("near_chunks", F.lit(1)))).withColumn("unit", F.explode(span(F.col("near_units"))))
    to_far = rows.where("NOT near OR NOT own").withColumn("chunk", _slot(F.greatest("far_chunks", F.lit(1)))).withColumn("unit", F.explode(F.transform(span(F.col("far_units")), lambda u: u + F.col("near_units"))))
    queries = to_near.unionByName(to_far).withColumn("role", F.lit(1))
    return members.unionByName(queries).withColumn("star", F.col("near") & (F.col("role") == 0)).withColumn("whole", F.lit(False)).select(*_UNIT_COLUMNS)


# -- components --------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(s1, s2, label) of every linked set: the least set of its component.

    Least labels spread along links and jump to their label's label, one written table a round. Sets with very many
    links and labels of very many sets are split over tasks.
    """
    a, b = F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")), F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2"))
    # Both directions from one pass: a union of the links with themselves would find them twice.
    both = links.select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("edge")).select("edge.a", "edge.b")
    edges = written(both.where("a <> b").distinct(), "ngram-edges")
    hubs = hot_keys(edges, ["b"])
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "ngram-labels")
    while True:
        near = salted_join(edges, labels.withColumnRenamed("node", "b"), ["b"], ["a"], hot=hubs).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = salted_join(labels, further, ["label"], ["node"], "left", hot_keys(labels, ["label"]))
        moved = written(jumped.join(near, "node").select("node", F.least("label", "near", "further").alias("new"), "label"), "ngram-labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels.select("node.s1", "node.s2", "label")


def stands_for(rows: DataFrame) -> DataFrame:
    """Of each set (s1, s2): its smallest doc_id (null only if all are), the name of a row that has the text, and how many rows have that name."""
    named = rows.groupBy("s1", "s2", "doc_id", "h").agg(F.count("*").alias("repeats"))
    first = F.min_by(F.struct(row_name(F.col("doc_id"), F.col("h")).alias("name"), "repeats"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("row")
    return named.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), first).select("s1", "s2", "doc_id", "row.name", "row.repeats")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Whole texts; null and blank texts have no shingles and link with nothing, not even each other. Equal sets
    always link. Repeated rows stay; rows with a null id link like others, and a component of null ids only has id null.
    """
    bounded_batches(docs.sparkSession)
    rows, counts = sketch(docs, key, text)
    with scratch(docs.sparkSession):
        sets = stands_for(rows.where("n > 0"))
        frequent, df = frequent_tokens(counts)
        postings = shared_postings(docs, text, frequent, df)
        grouped = written(
            postings.groupBy("s1", "s2").agg(F.max(F.struct("df", "token")).alias("top"), F.count("*").alias("shared"), F.max("n").alias("n")).select("s1", "s2", group_name(F.col("top.token"), F.col("n")).alias("g"), "shared", "n"), "ngram-groups"
        )
        groups = grouped.groupBy("g").agg(F.count("*").alias("size"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.struct("shared", "s1", "s2")).alias("c"))
        groups = written(groups.select("g", "size", "n_min", "n_max", F.col("c.s1").alias("c1"), F.col("c.s2").alias("c2")), "ngram-sizes")
        pairs = group_pairs(token_groups(postings, grouped), groups)
        alive = pairs.select(F.explode(F.array("g", "h")).alias("g")).distinct()
        members = written(grouped.join(alive, "g").select("s1", "s2", "g"), "ngram-members")
        texts = active_texts(docs, key, text, sets, members)
        linked_sets = components(find_links(texts, members, groups, pairs))
        sets = sets.select("s1", "s2", "doc_id")
        named = written(sets.join(linked_sets, ["s1", "s2"]), "ngram-named")
        least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_set = written(salted_join(named, least, ["label"], ["s1", "s2"], hot=hot_keys(named, ["label"])).select("s1", "s2", "component_id"), "ngram-components")
        of_set = written(sets.withColumnRenamed("doc_id", "own_id").join(of_set.withColumn("linked", F.lit(True)), ["s1", "s2"], "left").select("s1", "s2", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("own_id")).alias("component_id")), "ngram-components", keep=True)
    alive = rows.where("n > 0")
    joined = salted_join(alive, of_set, ["s1", "s2"], ["doc_id"], hot=hot_keys(alive, ["s1", "s2"])).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
