"""Ranked lexical search over impact vectors in buckets of like length.

Each document is a vector of impacts over the terms of the queries, each query one of term weights, and a score is
their inner product. Documents are ordered by the length of their vectors and stored in that order. A bucket whose
greatest length times the query's cannot reach the score of the query's k-th best document is skipped
(Cauchy-Schwarz), and so are all shorter ones; within a bucket the query's heaviest coordinates, with a bound on what
the others can add, filter the documents. What survives is scored exactly in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.common import bounded_batches, scratch, written

TOP = 20
#: Queries of a block: the terms of so many at most are broadcast at a time; more queries are taken in several blocks.
BLOCK_QUERIES = 500
BLOCK_TERMS = 16_384
#: Documents of a bucket that meet the queries at once.
BUCKET = 512
#: The buckets of greatest length, with about this share of the documents, give the first bounds.
FIRST_SHARE = 0.02
#: The bounds are in doubles, the scores in integers; this is far above their rounding.
SLACK = 1.0 + 1e-9
#: Every byte that is no part of a term, as a space; A to Z in lower case. Bytes above 0x7F belong to terms.
_FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to the score, in 64-bit integers; ``n`` is the length of the document that each belongs to."""
    m = 75 + (25 * n * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Block:
    """Queries with the ids of their terms."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]


def query_blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The queries that have a term, in blocks of bounded size; they come partition by partition, so the driver holds few."""
    ids, counts, words = [], [], set()

    def block() -> Block:
        vocabulary = {w: i for i, w in enumerate(sorted(words))}
        terms = [np.array([vocabulary[w] for w in c], np.int64) for c in counts]
        return Block(list(ids), vocabulary, terms, [np.array(list(c.values()), np.int64) for c in counts])

    for row in items.select(items[f"`{key}`"].alias("k"), F.coalesce(items[f"`{text}`"], F.lit("")).cast("binary").alias("t")).toLocalIterator():
        found = Counter(terms_of(bytes(row["t"])))
        if not found:
            continue
        if ids and (len(ids) >= BLOCK_QUERIES or len(words | found.keys()) > BLOCK_TERMS):
            yield block()
            ids, counts, words = [], [], set()
        ids.append(row["k"])
        counts.append(found)
        words |= found.keys()
    if ids:
        yield block()


def lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int32()))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of the lists of a column."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(k, n, terms, tfs) of every document with a term: its length, and how often it has each term of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            rows, n, sizes, terms, tfs = [], [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, t in enumerate(batch.column(1)):
                words = terms_of(t.as_py())
                if not words:
                    continue
                hits = np.bincount(np.array([x for x in map(get, words) if x is not None], np.int64), minlength=width)
                at = np.flatnonzero(hits)
                rows.append(i)
                n.append(len(words))
                sizes.append(len(at))
                terms.append(at)
                tfs.append(hits[at])
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), lists(sizes, np.concatenate(terms)), lists(sizes, np.concatenate(tfs))], ["k", "n", "terms", "tfs"])

    rows = docs.select(docs[f"`{key}`"].cast("long").alias("k"), docs[f"`{text}`"].cast("binary").alias("t")).where("t IS NOT NULL")
    return rows.mapInArrow(run, "k long, n long, terms array<int>, tfs array<int>")


def frequencies(vectors: DataFrame, width: int) -> np.ndarray:
    """How many documents have each term; at most one row a term reaches the driver, and one a term and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(flat(batch.column(0))[1], minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(width, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def by_length(vectors: DataFrame, documents: int, total: int) -> DataFrame:
    """(length, k, terms, impacts), ordered by falling length over all partitions and written so. Vectors of length 0 score 0 and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms = flat(batch.column(2))
            tfs = flat(batch.column(3))[1].astype(np.int64)
            impact = impacts(tfs, np.repeat(batch.column(1).to_numpy(), np.diff(at)), documents, total)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            length = np.sqrt(np.bincount(owner, weights=impact.astype(np.float64) ** 2, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(length), batch.column(0), lists(np.diff(at), terms), lists(np.diff(at), impact)], ["length", "k", "terms", "impacts"])

    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.mapInArrow(run, "length double, k long, terms array<int>, impacts array<int>").where("length > 0")
    # The hash parts documents of equal length, such as the copies of one text.
    order = [F.col("length").desc(), F.xxhash64("k")]
    return written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "impact-vectors")


class Search:
    """The queries of a block against buckets of falling length; keeps each query's best documents so far."""

    def __init__(self, block: Block, weights: np.ndarray, floors: np.ndarray, top: int):
        self.width, self.top = len(weights), top
        self.bound = floors.copy()
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * len(block.terms)
        self.queries = []
        for terms, times in zip(block.terms, block.times, strict=True):
            q = times * weights[terms]
            order = np.argsort(-q, kind="stable")
            terms, q = terms[order], q[order]
            rest = np.sqrt(np.concatenate([np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], [0.0]]))
            self.queries.append((terms, q, rest))
        self.reach = np.array([rest[0] for _, _, rest in self.queries])

    def alive(self, length: float) -> np.ndarray:
        """Queries that a document of at most this length can still satisfy."""
        return np.flatnonzero((self.reach > 0) & (self.reach * length * SLACK >= self.bound))

    def bucket(self, lengths: np.ndarray, keys: np.ndarray, missing: np.ndarray, at: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> bool:
        """False if no query can have a hit here or in any bucket after it."""
        alive = self.alive(lengths.max())
        if not len(alive):
            return False
        dense = np.zeros((self.width, len(lengths)), np.int64)
        dense[terms, np.repeat(np.arange(len(lengths)), np.diff(at))] = impact
        squares = lengths**2
        for i in alive:
            q_terms, q, rest = self.queries[i]
            # As many of the heaviest coordinates as it takes for a document without any of them to fall short.
            short = np.flatnonzero(rest * lengths.max() * SLACK < self.bound[i])
            focus = int(short[0]) if len(short) else len(q)
            head = dense[q_terms[:focus]]
            part = q[:focus] @ head
            left = np.sqrt(np.maximum(0.0, squares * SLACK - (head.astype(np.float64) ** 2).sum(axis=0)))
            found = np.flatnonzero((part + rest[focus] * left) * SLACK >= self.bound[i])
            if len(found):
                self.keep(i, part[found] + q[focus:] @ dense[q_terms[focus:]][:, found], missing[found], keys[found])
        return True

    def keep(self, i: int, score: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> None:
        good = score >= max(1, int(self.bound[i]))
        merged = [np.concatenate(x) for x in zip(self.best[i], (score[good], missing[good], keys[good]), strict=True)]
        order = np.lexsort((merged[2], merged[1], -merged[0]))[: self.top]
        self.best[i] = tuple(m[order] for m in merged)
        if len(order) == self.top:
            self.bound[i] = max(self.bound[i], self.best[i][0][-1])

    def rows(self) -> pa.RecordBatch:
        n = [len(b[0]) for b in self.best]
        score, missing, keys = (np.concatenate([b[j] for b in self.best]) for j in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), pa.array(keys, pa.int64(), mask=missing), pa.array(score, pa.int64())], ["q", "doc_id", "score"])


def hits(vectors: DataFrame, block: Block, weights: np.ndarray, floors: np.ndarray, top: int) -> DataFrame:
    """(q, doc_id, score): of each task at most ``top`` documents a query, among them all of the final ones."""
    shared = vectors.sparkSession.sparkContext.broadcast((block, weights, floors))
    # One query may have more terms than a block's bound; then fewer documents meet it at once.
    bucket = max(1, min(BUCKET, BUCKET * BLOCK_TERMS // max(1, len(weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, top)
        for batch in batches:
            length, key = batch.column(0).to_numpy(), batch.column(1)
            keys, missing = key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)
            at, terms = flat(batch.column(2))
            impact = flat(batch.column(3))[1].astype(np.int64)
            for a in range(0, len(length), bucket):
                b = min(a + bucket, len(length))
                part = slice(at[a], at[b])
                search.bucket(length[a:b], keys[a:b], missing[a:b], at[a : b + 1], terms[part], impact[part])
        yield search.rows()

    return vectors.mapInArrow(run, "q int, doc_id long, score long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """Each query's ``top`` rows with their rank. They are limited before the shuffle too, so no task gets more than that from each other one."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with the highest score above 0 for each row of ``items``.

    Equal scores are ranked by ascending doc_id, null ids last. Null and empty texts, and texts without a term, are no
    documents and no queries. Repeated rows are documents, and queries, of their own. Whole texts; columns besides the
    named ones are not read. Of each block of queries the terms are broadcast (at most ``BLOCK_TERMS``, or those of
    one query), and the documents are read once.
    """
    bounded_batches(docs.sparkSession, BUCKET)
    out = None
    for block in query_blocks(items, item, query):
        found = _search_block(docs, block, top, key, text)
        out = found if out is None else out.unionByName(found)
    kind = dict(items.dtypes)[item]
    empty = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return empty if out is None else out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: Block, top: int, key: str, text: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    with scratch(spark):
        vectors = written(term_vectors(docs, block.vocabulary, key, text), "term-vectors")
        size = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
        documents, total = size["documents"], size["total"] or 0
        df = frequencies(vectors, len(block.vocabulary))
        weights = np.array([weight(int(x), documents) for x in df], np.int64)
        ordered = by_length(vectors, documents, max(1, total))
        cut = ordered.agg(F.percentile_approx("length", 1 - FIRST_SHARE, 10_000).alias("cut")).first()["cut"]
        none = np.zeros(len(block.terms))
        if cut is None:
            found = written(hits(ordered, block, weights, none, top), "lexical-first")
        else:
            first = written(best_of(hits(ordered.where(F.col("length") >= cut), block, weights, none, top), top), "lexical-first").drop("rank")
            floors = none.copy()
            for r in first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).collect():
                floors[r["q"]] = r["least"]
            found = written(first.unionByName(hits(ordered.where(F.col("length") < cut), block, weights, floors, top)), "lexical-hits")
        kind = "long" if all(isinstance(i, int | None) for i in block.ids) else "string"
        named = spark.createDataFrame([(i, k) for i, k in enumerate(block.ids)], f"q int, item_id {kind}")
        return written(best_of(found, top).join(F.broadcast(named), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-best", keep=True)
