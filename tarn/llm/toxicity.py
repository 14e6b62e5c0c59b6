"""A toxicity classifier that is regularised by counterfactuals.

Identity terms of labelled sentences are swapped for others of their kind, and the fit penalises the squared
change of the score, so that a neutral mention of a group is not taken for toxicity. Beside the terms that are listed
here, terms of the corpus are learnt: words that occur in toxic texts more often than elsewhere, but mostly outside
them, as names of groups do that are talked of both neutrally and with abuse. Those that stand in like contexts, next to
the same words, are of a kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import scratch, written
from tarn.llm.linear import MAX_FEATURES, MAX_LABELLED, Indexer, Rows, as_bytes, class_counts, feature_counts, features_with, is_training, labelled_sample, minimise, select_features, small_batches, word_features

#: Identity terms by kind; a swap stays within its kind.
IDENTITIES = tuple(
    tuple(line.split())
    for line in """women men girls boys
woman man girl boy
muslim christian jewish hindu buddhist atheist catholic
muslims christians jews hindus buddhists atheists catholics
black white asian latino arab african european american mexican chinese indian
gay straight lesbian bisexual homosexual heterosexual transgender queer
immigrants refugees foreigners natives migrants
disabled deaf blind autistic
femmes hommes filles garçons
musulmans chrétiens juifs bouddhistes athées
frauen männer mädchen jungen
muslime christen juden buddhisten atheisten
ausländer einwanderer flüchtlinge einheimische
mujeres hombres chicas chicos
musulmanes cristianos judíos budistas ateos""".splitlines()
)
#: At most so many terms are learnt from the labelled rows.
MAX_TERMS = 256
LISTED = frozenset(t for kind in IDENTITIES for t in kind)
#: Neighbours by which the learnt terms are told apart, and terms of a learnt kind.
MAX_NEIGHBOURS = 4096
KIND = 4
#: A learnt term is in so many texts of either class, in at most this share of all, and at most this share of its texts are toxic.
LEAST_TEXTS, MOST_TEXTS, MOST_TOXIC = 5, 0.2, 0.5
_WORD = re.compile(r"\w+")


def swaps(kinds: Iterable[tuple[str, ...]]) -> dict[str, str]:
    """Each term's successor in its kind; a term of several kinds keeps to the first."""
    out: dict[str, str] = {}
    for kind in kinds:
        for i, t in enumerate(kind):
            if len(kind) > 1:
                out.setdefault(t, kind[(i + 1) % len(kind)])
    return out


def swapped(text: str, swap: dict[str, str]) -> str | None:
    """The text with each identity term swapped, or None if it has none."""
    out, n = [], 0
    for m in _WORD.finditer(text):
        other = swap.get(m[0].lower())
        if other is not None:
            out += [text[n : m.start()], other]
            n = m.end()
    return "".join(out) + text[n:] if out else None


def learnt_terms(counted: DataFrame, classes: dict[str, int], bound: int = MAX_TERMS) -> list[str]:
    """The corpus's own terms that are mentioned in texts of both classes and lean towards toxic ones, the most frequent first."""
    total, base = sum(classes.values()), classes["1"] / sum(classes.values())
    toxic, clean = F.coalesce(F.col("`1`"), F.lit(0)), F.coalesce(F.col("`0`"), F.lit(0))
    rows = counted.where(F.col("f").startswith("w:")).select(F.substring("f", 3, 1 << 30).alias("term"), toxic.alias("toxic"), (toxic + clean).alias("n"))
    share = F.col("toxic") / F.col("n")
    fit = (F.col("toxic") >= LEAST_TEXTS) & (F.col("n") - F.col("toxic") >= LEAST_TEXTS) & (F.col("n") <= MOST_TEXTS * total) & (share > base) & (share <= MOST_TOXIC)
    return [r["term"] for r in rows.where(fit).orderBy(F.col("n").desc(), "term").limit(bound).collect()]


def neighbours(sample: DataFrame, terms: list[str], bound: int = MAX_NEIGHBOURS) -> list[tuple[str, str, int]]:
    """(term, neighbour, how often) for the ``bound`` most frequent neighbours of the terms: the word before (``<``) and the word behind (``>``)."""
    wanted = frozenset(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                words = _WORD.findall(text.lower())
                for i, w in enumerate(words):
                    if w in wanted:
                        held.update([(w, "<" + words[i - 1])] if i else [])
                        held.update([(w, ">" + words[i + 1])] if i + 1 < len(words) else [])
        yield pd.DataFrame([(*k, n) for k, n in held.items()], columns=["term", "neighbour", "n"])

    met = written(sample.mapInPandas(count, "term string, neighbour string, n long").groupBy("term", "neighbour").agg(F.sum("n").alias("n")), "neighbours")
    frequent = met.groupBy("neighbour").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "neighbour").limit(bound).select("neighbour")
    return [tuple(r) for r in met.join(F.broadcast(frequent), "neighbour").select("term", "neighbour", "n").collect()]


def kinds_by_context(terms: list[str], met: list[tuple[str, str, int]], size: int = KIND) -> list[tuple[str, ...]]:
    """Terms that stand in like contexts: the first that is left, in the given order, with those most like it.

    A term's context is how much more often than by chance it has each neighbour (positive pointwise mutual information),
    likeness its cosine; equal ones go in the given order.
    """
    if len(terms) < 2:
        return []
    columns = {c: i for i, c in enumerate(sorted({c for _, c, _ in met}))}
    place = {t: i for i, t in enumerate(terms)}
    counts = np.zeros((len(terms), max(1, len(columns))))
    for t, c, n in met:
        counts[place[t], columns[c]] = n
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0, keepdims=True) / max(1.0, counts.sum())
    context = np.log(np.maximum(1.0, np.divide(counts, expected, out=np.ones_like(counts), where=expected > 0)))
    lengths = np.linalg.norm(context, axis=1)
    context /= np.where(lengths > 0, lengths, 1.0)[:, None]
    like, left, out = context @ context.T, list(range(len(terms))), []
    while len(left) > 1:
        first = left[0]
        nearest = sorted(left[1:], key=lambda j: (-round(like[first, j], 9), j))[: size - 1]
        out.append(tuple(terms[j] for j in (first, *nearest)))
        left = [j for j in left[1:] if j not in nearest]
    return out


@dataclass
class ToxicityModel:
    features: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = -20.0
    swap: dict[str, str] = field(default_factory=dict)
    pairs: int = 0

    def scorer(self):
        index, w, bias = Indexer(self.features), np.array(self.weights + [0.0]), self.bias
        return lambda text: float(1 / (1 + np.exp(-np.clip(bias + w[index(text)].sum(), -50, 50))))


def fit_rows(rows: list[bytes], y: np.ndarray, pairs: list[tuple[bytes, bytes]], width: int, l2: float = 0.005, counterfactual: float = 20.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic loss, rarer class weighted by the root of the imbalance, plus l2 and ``counterfactual`` times the mean squared score change of the pairs."""
    x, n1 = Rows(rows, width), max(1.0, float(y.sum()))
    weight = np.where(y == 1, np.sqrt(max(1.0, (len(y) - n1) / n1)), 1.0)
    weight /= weight.sum()
    before, after = Rows([a for a, _ in pairs], width), Rows([b for _, b in pairs], width)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-1], p[-1]
        z = x.times(w) + b
        d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        value = float(((np.logaddexp(0, z) - y * z) * weight).sum() + l2 * (w @ w) / 20)
        g = x.transposed_times(d) + l2 * w / 10
        if pairs:
            change = before.times(w) - after.times(w)
            value += float(change @ change) * counterfactual / len(pairs)
            change *= 2 * counterfactual / len(pairs)
            g += before.transposed_times(change) - after.transposed_times(change)
        return value, np.append(g, d.sum())

    p = minimise(loss, np.zeros(width + 1), steps)
    return p[:-1], float(p[-1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, counterfactual: float = 20.0, l2: float = 0.005, most_features: int = MAX_FEATURES, most_terms: int = MAX_TERMS) -> ToxicityModel:
    """Learns ``labels.toxic`` from the texts of at most ``bound`` labelled rows outside the held-out fold, by at most ``most_features`` features.

    Terms to swap are those of ``IDENTITIES`` and at most ``most_terms`` learnt ones; the model keeps them as ``swap``.

    Without labelled rows every score is near 0; with one class only, scores are its smoothed share.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, bound, counterfactual, l2, most_features, most_terms)


def _fit(docs: DataFrame, labels: DataFrame, bound: int, counterfactual: float, l2: float, most_features: int, most_terms: int) -> ToxicityModel:
    sample = labelled_sample(small_batches(docs), labels, F.col("toxic"), bound)
    counts = class_counts(sample)
    total, toxic = sum(counts.values()), counts.get("1", 0)
    if not total:
        return ToxicityModel()
    if toxic in (0, total):
        share = (toxic + 0.5) / (total + 1)
        return ToxicityModel(bias=float(np.log(share / (1 - share))))
    counted = feature_counts(sample, features_with(False), counts)
    terms = [t for t in learnt_terms(counted, counts, most_terms) if t not in LISTED]
    swap = swaps([*IDENTITIES, *kinds_by_context(terms, neighbours(sample, terms))])
    features = select_features(counted, counts, most_features, always=frozenset(f for t in swap for f in word_features(t)))

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Indexer(features)
        for b in batches:
            other = [swapped(t, swap) for t in b["text"]]
            yield pd.DataFrame({"y": (b["y"] == "1").astype("int32"), "ids": [as_bytes(index(t)) for t in b["text"]], "other": [None if t is None else as_bytes(index(t)) for t in other]})

    got = sample.mapInPandas(index_rows, "y int, ids binary, other binary").collect()
    rows = [bytes(r["ids"]) for r in got]
    pairs = [(ids, bytes(r["other"])) for ids, r in zip(rows, got, strict=True) if r["other"] is not None]
    y = np.array([r["y"] for r in got])
    del got
    w, bias = fit_rows(rows, y, pairs, len(features), l2, counterfactual)
    return ToxicityModel(features, w.tolist(), bias, swap, len(pairs))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the columns in ``keep`` (names may clash: they come as a struct ``row``).

    Whole texts; null counts as empty. held_out is false for a null doc_id.
    """
    names = keep if keep is not None else ["doc_id"]
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = model.scorer()
        for texts in batches:
            yield pd.Series([s(t) for t in texts], dtype="float64")

    value = F.pandas_udf(scores, "double")
    scored = rows.withColumn("score", value("text"))
    held = ~is_training(F.col("row.doc_id")) & F.col("row.doc_id").isNotNull()
    out = ["row"] if keep is not None else []
    return scored.select(*out, F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted to these documents, does not reject."""
    model = fit(docs, labels)
    return score(docs, model, docs.columns).where("predicted = 0").select("row.*")


def neutral_mentions(docs: DataFrame, labels: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row: of the held-out clean rows, those that mention a term of the model and those that do not, and how many of each are taken for toxic.

    The figures by which the penalty is judged: (mentions, mentions_rejected, others, others_rejected).
    """
    terms = frozenset(model.swap)

    def mentioned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not terms.isdisjoint(_WORD.findall(t.lower())) for t in texts], dtype=bool)

    clean = labels.where("toxic = 0").select("doc_id").distinct()
    scored = score(docs.join(clean, "doc_id", "left_semi"), model, ["doc_id", "text"]).where("held_out")
    rows = scored.select(F.pandas_udf(mentioned, "boolean")(F.coalesce("row.text", F.lit(""))).alias("mention"), (F.col("predicted") == 1).alias("rejected"))
    mention, rejected = F.col("mention"), F.col("rejected")
    return rows.agg(F.count_if(mention).alias("mentions"), F.count_if(mention & rejected).alias("mentions_rejected"), F.count_if(~mention).alias("others"), F.count_if(~mention & rejected).alias("others_rejected"))
