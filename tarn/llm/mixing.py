"""Mixing to target weights with soft domain membership.

A classifier fitted to the labelled table gives each document a posterior over domains. A least-squares fit, solved
by Newton steps on its dual, finds document rates, none negative, whose expected tokens in each domain meet the targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SPACE_RUN, scratch, written
from tarn.llm.linear import Indexer, Rows, as_bytes, class_counts, feature_counts, features_with, labelled_sample, minimise, select_features, small_batches

#: Shares of the tokens that each domain (quality and toxic label) is to have.
DOMAIN_WEIGHTS = {"q1t0": 0.92, "q0t0": 0.06, "q1t1": 0.015, "q0t1": 0.005}
#: Bounds of the domain classifier: labelled rows, features (on held-out rows of sf0.1 the log loss is 0.134 with 1024, 0.142 with 2048, 0.160 with 4096), and steps after which its fit ends at the latest.
MAX_DOMAIN_ROWS = 10_000
MAX_DOMAIN_FEATURES = 1024
DOMAIN_STEPS = 300
#: Newton steps after which the fit is given up with a warning; it takes 10 to 30.
MAX_ROUNDS = 200
TOLERANCE = 1e-6
#: Weights of the rates' distance from 1 against the totals' distance from their targets: where the fit starts, and ends.
FIRST_EASE, LAST_EASE = 1e-3, 1e-8


def domain_of(**labels: str) -> Column:
    """The domain that a row of the labelled table names, its labels' values behind their letters; null if a label is.

    By default quality and toxic: ``q1t0``. A corpus without toxic documents is mixed by quality alone: ``domain_of(q="quality")``.
    """
    return F.concat(*(F.concat(F.lit(letter), F.col(c).cast("string")) for letter, c in (labels or {"q": "quality", "t": "toxic"}).items()))


@dataclass
class DomainModel:
    """Multinomial logistic model over presence and shape features."""

    domains: list[str]
    features: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)

    def posteriors(self):
        index = Indexer(self.features, shapes=True)
        w, b = np.array(self.weights).reshape(len(self.features), len(self.domains)), np.array(self.bias)

        def of(text: str) -> np.ndarray:
            z = b + w[index(text)].sum(axis=0)
            e = np.exp(z - z.max())
            return e / e.sum()

        return of


def fit_domains(
    docs: DataFrame, labels: DataFrame, bound: int = MAX_DOMAIN_ROWS, l2: float = 0.002, domain: Column | None = None, most_features: int = MAX_DOMAIN_FEATURES, steps: int = DOMAIN_STEPS
) -> DomainModel:
    """Fitted to at most ``bound`` labelled rows and ``most_features`` features; without any row there is one domain, ``all``.

    Every domain of the labelled table is one of the model. One without a row among those has no text to learn from:
    its posterior is 0 everywhere, and its target stays unmet.
    """
    with scratch(docs.sparkSession):
        return _fit_domains(docs, labels, bound, l2, domain_of() if domain is None else domain, most_features, steps)


def _fit_domains(docs: DataFrame, labels: DataFrame, bound: int, l2: float, domain: Column, most_features: int, steps: int) -> DomainModel:
    sample = labelled_sample(small_batches(docs), labels, domain, bound)
    counts = class_counts(sample)
    if not counts:
        return DomainModel(["all"], bias=[0.0])
    unseen = sorted({r["y"] for r in labels.select(domain.alias("y")).where("y IS NOT NULL").distinct().collect()} - set(counts))
    never = [-np.inf] * len(unseen)
    domains = sorted(counts)
    if len(domains) < 2:
        return DomainModel(domains + unseen, bias=[0.0, *never])
    features = select_features(feature_counts(sample, features_with(True), counts), counts, most_features)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Indexer(features, shapes=True)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "ids": [as_bytes(index(t)) for t in b["text"]]})

    got = sample.mapInPandas(index_rows, "y string, ids binary").collect()
    x, k, width = Rows([bytes(r["ids"]) for r in got], len(features)), len(domains), len(features)
    y = np.zeros((len(got), k))
    y[np.arange(len(got)), [domains.index(r["y"]) for r in got]] = 1
    del got

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        p = p.reshape(width + 1, k)
        z = np.stack([x.times(p[:-1, j]) for j in range(k)], axis=1) + p[-1]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        sums = e.sum(axis=1, keepdims=True)
        d = (e / sums - y) / len(y)
        g = np.stack([x.transposed_times(d[:, j]) for j in range(k)], axis=1) + l2 * p[:-1]
        return float((np.log(sums)[:, 0] - (z * y).sum(axis=1)).mean() + l2 * (p[:-1] ** 2).sum() / 2), np.vstack([g, d.sum(axis=0)]).ravel()

    p = minimise(loss, np.zeros((width + 1) * k), steps).reshape(width + 1, k)
    return DomainModel(domains + unseen, features, np.hstack([p[:-1], np.zeros((width, len(unseen)))]).tolist(), p[-1].tolist() + never)


def memberships(docs: DataFrame, model: DomainModel, keep: list[str] | None = None) -> DataFrame:
    """doc_id, tokens (words apart by white space), p (posterior of each domain), share (the id as a number in [0, 1), of a null id the text) of every row, and a struct ``row`` of the columns in ``keep``."""
    names = keep if keep is not None else ["doc_id"]
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def posteriors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.posteriors()
        for texts in batches:
            yield pd.Series([of(t).tolist() for t in texts])

    p = F.pandas_udf(posteriors, "array<double>")
    tokens = F.size(F.filter(F.split("text", SPACE_RUN), lambda w: w != "")).cast("long")
    out = ["row"] if keep is not None else []
    named = F.xxhash64("row.doc_id", F.when(F.col("row.doc_id").isNull(), F.col("text")))
    share = F.pmod(named, F.lit(1 << 53)) / float(1 << 53)
    return rows.withColumn("p", p("text")).select(*out, F.col("row.doc_id").alias("doc_id"), tokens.alias("tokens"), "p", share.alias("share"))


def targets(domains: list[str], weights: Mapping[str, float], total: float) -> np.ndarray:
    """Token totals; the shares of the domains that exist are scaled to one, and domains without a weight share alike in what an unknown one gets."""
    w = np.array([weights.get(d, 1.0 / len(domains)) for d in domains], dtype=float)
    return total * w / w.sum()


def unbounded_rate(step: np.ndarray) -> Column:
    return F.lit(1.0) - sum((F.get("p", F.lit(k)) * float(c) for k, c in enumerate(step)), F.lit(0.0))


def not_negative(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), rate)


def rate_column(history: list[np.ndarray]) -> Column:
    """The rate of a document: it follows from its posterior and the fit's few numbers, of which there is one step or none."""
    return not_negative(unbounded_rate(history[0])) if history else F.lit(1.0)


def fit_rates(members: DataFrame, domains: list[str], weights: Mapping[str, float], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The step from rate 1 (none where the targets are met as it is), the domain totals that it reaches, and the targets.

    Of all rates that are not negative whose totals are nearest to the targets, in the metric of the token-weighted second
    moments of the posteriors, those nearest to 1: least squares with a slight weight on the distance from 1, which
    falls to ``LAST_EASE`` as the fit goes on. The dual has one number a domain and is convex and piecewise quadratic;
    Newton steps with a line search solve it. The fit ends when each total is within ``tolerance`` of all tokens of its
    target, or, where no rates reach them, when the dual's gradient is that small or a Newton step can gain no more than
    the sums' rounding, which proves the totals the nearest; a warning tells of a miss. What each distributed sum sends to
    the driver is of the order of the squared number of domains.
    """
    k = len(domains)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def conjugate(at: np.ndarray) -> Column:
        free = unbounded_rate(at)
        return F.sum(F.col("tokens") * not_negative(free) * (free - not_negative(free) / 2))

    def sums(at: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """All tokens, the dual's sum, the domain totals, and the second moments of the rows whose rate is above 0."""
        rated = members.select(F.col("tokens").cast("double").alias("tokens"), "p", unbounded_rate(at).alias("free"))
        rated = rated.select("tokens", "p", "free", (F.col("tokens") * not_negative(F.col("free"))).alias("out"), F.when(F.col("free") > 0, F.col("tokens")).otherwise(0.0).alias("between"))
        row = rated.agg(
            F.sum("tokens").alias("n"), F.sum(F.col("out") * (F.col("free") - not_negative(F.col("free")) / 2)).alias("value"),
            *[F.sum(F.col("out") * p[i]).alias(f"t{i}") for i in range(k)], *[F.sum(F.col("between") * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in upper],
        ).first()
        if not row["n"]:
            return 0.0, 0.0, np.zeros(k), np.zeros((k, k))
        g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return row["n"], row["value"], np.array([row[f"t{i}"] for i in range(k)]), g

    def dual(value: float, at: np.ndarray) -> float:
        return value + goal @ at + ease * (at @ metric @ at) / 2

    at = np.zeros(k)
    total, value, reached, g = sums(at)
    goal = targets(domains, weights, total)
    if not total:
        return [], reached, goal
    # Numbers outside the posteriors' span move no rate.
    size, span = np.linalg.eigh(g)
    span = span[:, size > 1e-12 * total]
    metric, ease, fall = g, FIRST_EASE, 0.1
    steps, straight = 0, True

    def newton(slope: np.ndarray) -> np.ndarray:
        return -span @ np.linalg.solve(span.T @ (g + ease * metric) @ span, span.T @ slope)

    for n in range(rounds + 1):
        off = np.abs(reached - goal).max()
        slope = span @ (span.T @ (goal - reached + ease * (metric @ at)))
        if off <= tolerance * total:
            break
        step = newton(slope)
        if np.abs(slope).max() <= (tolerance * total if ease <= LAST_EASE else max(tolerance * total, 1e-3 * off)) or -(slope @ step) <= 1e-13 * abs(value):
            if ease <= LAST_EASE:
                break
            fall = max(1e-4, fall * fall) if straight and steps <= 2 else 0.1
            ease, steps, straight = max(LAST_EASE, ease * fall), 0, True
            slope = span @ (span.T @ (goal - reached + ease * (metric @ at)))
            step = newton(slope)
        if n == rounds:
            break
        enough = dual(value, at) + 1e-4 * (slope @ step) + 1e-12 * total + 1e-14 * abs(value)
        _, value, reached, g = sums(at + step)
        if dual(value, at + step) > enough:
            # Too far: of several shorter steps, all tried in one pass, the best.
            shorter = [step / 4.0**i for i in range(1, 9)]
            row = members.agg(*[conjugate(at + s).alias(f"v{i}") for i, s in enumerate(shorter)]).first()
            step = min(enumerate(shorter), key=lambda s: dual(row[f"v{s[0]}"], at + s[1]))[1]
            _, value, reached, g = sums(at + step)
            straight = False
        at, steps = at + step, steps + 1
    if np.abs(reached - goal).max() > tolerance * total:
        warnings.warn(f"no rates reach the targets after {n} steps: totals {dict(zip(domains, reached, strict=True))}, targets {dict(zip(domains, goal, strict=True))}", stacklevel=2)
    return [at] if at.any() else [], reached, goal


@dataclass
class Mix:
    """What a fit was asked for and what it reached: expected tokens in each domain."""

    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray


def mixed(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = DOMAIN_WEIGHTS, keep: list[str] | None = None, domain: Column | None = None) -> tuple[DataFrame, Mix]:
    """Per row: doc_id, tokens, p, share, rate, expected_tokens, copies (and ``row``); and the targets with what was reached.

    ``copies`` rounds the rate to a whole number of times by a hash of the id (of the text where the id is null), so its
    expected value is the rate. Empty and null texts have no tokens but a rate like others of their posterior; all rows,
    repeated ones too, get one, and rows that repeat an id round alike. No rows: none. Texts of any length are read whole.
    """
    model = fit_domains(docs, labels, domain=domain)
    members = written(memberships(docs, model, keep), "memberships")
    history, reached, goal = fit_rates(members, model.domains, weights)
    rated = members.withColumn("rate", rate_column(history))
    rated = rated.withColumn("expected_tokens", F.col("rate") * F.col("tokens")).withColumn("copies", (F.floor("rate") + (F.col("share") < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    return rated, Mix(model.domains, goal, reached)


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = DOMAIN_WEIGHTS, domain: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate asks."""
    rated, _ = mixed(docs, labels, weights, docs.columns, domain)
    return rated.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
