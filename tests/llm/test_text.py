"""Pieces, spot signatures, n-gram groups, toxicity and mixing against plain versions."""

import hashlib
import itertools
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tarn.llm import mixing, ngram_groups, spot_signatures, toxicity
from tarn.llm.linear import Rows, as_bytes
from tarn.llm.pieces import PieceTable, encode_decode
from tarn.llm.queries import piece_model

ODD = [None, "", " ", "   ", "▁", "a\n\nb", "<s></s><0x0A>", "日本😀é", "x" * 5000, "word " * 4000, "\x00\t", "don't e.g. 3.14% -- (a)b"]


@pytest.fixture(scope="module")
def table():
    with open(piece_model(), "rb") as f:
        return PieceTable(f.read())


def test_pieces_equal_the_library(table):
    r = random.Random(5)
    signs = "aábcdeghilmnorstuw  ▁\nÄ日😀01_-/=.,'\"()é"
    texts = [t or "" for t in ODD] + ["".join(r.choice(signs) for _ in range(r.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        assert table.encoded(t) == " ".join(map(str, table.sp.encode(t, add_eos=True)))


def test_encode_decode_query_columns(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a", 1), (1, "", 1)], "doc_id long, text string, ids int")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = encode_decode(df, piece_model(), ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        t = "a" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        want = sp.encode(t, add_eos=True)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (want, len(want), sp.decode(want))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert encode_decode(df.limit(0), piece_model()).count() == 0


def test_edited_texts(spark):
    docs = [(7, "The red kite of the north flew over a cold grey sea and the old boat."), (3, "Le chat de la maison dort."), (9, None), (1, "zzz"), (3, "Le chat de la maison dort."), (None, "le null of the id"), (12, "the sea of a word. " * 40_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, r string")
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    rows = spot_signatures.edited_likeness(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 3}) == 1
    assert spot_signatures.edited_likeness(df.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [None, 7])
def test_large_null_and_repeated_ids_come_back_whole(spark, ranges):
    """Ids that no double holds, beside nulls and at the cuts of ranges; a null and a repeated id have most of the rows."""
    r = random.Random(ranges)
    big = [(1 << 60) + i for i in range(40)] + [-(1 << 63), (1 << 63) - 1]
    docs = [(d, f"text {d} of the sea.") for d in big] + [(None, f"the null {i}") for i in range(300)] + [((1 << 60) + 7, f"the copy {i}") for i in range(300)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen = []

    def pairs(rows):
        for k, t, donor in rows:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t]), pa.array([donor])], ["k", "t", "donor"])

    for x in spot_signatures.with_next(df, pairs, "k long, t string, donor string", ranges=ranges).collect():
        seen.append(tuple(x))
    assert sorted([x[:2] for x in seen], key=str) == sorted(docs, key=str)
    # One circle through all rows, which falls in its ids and ends with the nulls.
    after, id_of = {t: donor for _, t, donor in seen}, {t: k for k, t in docs}
    at, order = f"text {(1 << 63) - 1} of the sea.", []
    for _ in docs:
        order.append(id_of[at])
        at = after[at]
    assert order == sorted([d for d, _ in docs], key=lambda d: (d is None, -(d or 0)))
    assert at == f"text {(1 << 63) - 1} of the sea."
    got = spot_signatures.edited_likeness(df).select("doc_id").collect()
    assert sorted([g[0] for g in got], key=str) == sorted([d for d, _ in docs], key=str)
    prints = spot_signatures.fingerprints(df).collect()
    assert sorted([g["doc_id"] for g in prints], key=str) == sorted([d for d, _ in docs], key=str)


def plain_signatures(text):
    """Chains as words: the anchor (or the start) and the next two content words, as far as there are any."""
    words = re.findall(r"\w+|[.!?|\n]", text.lower())
    content = [i for i, w in enumerate(words) if w not in spot_signatures.ANCHORS]
    out = set()
    for i in range(-1, len(words)):
        if i < 0 or words[i] in spot_signatures.ANCHORS:
            chain = [words[j] for j in content if j > i][:2]
            if chain or not content:
                out.add((words[i] if i >= 0 else None, *chain))
    return out


def test_signatures_equal_plain_chains():
    s, r = spot_signatures.Spots(), random.Random(8)
    words = ["the", "of", "la", "und", "kite", "sea", "boat", "red", "old", "cold", ".", "\n", "|", "?"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(300)] + ["kite", "the", "the kite", "A longer text of it. " * 40]
    plain = [plain_signatures(t) for t in texts]
    sets = [s.signatures(t) for t in texts]
    for t, a, b in zip(texts, sets, plain, strict=True):
        assert len(a) == len(b), t
    for i in range(0, 300, 2):
        a, b = plain[i], plain[i + 1]
        if a and b:
            assert abs(spot_signatures.likeness(sets[i], sets[i + 1]) - len(a & b) / len(a | b)) < 1e-9


def test_signature_chains():
    s = spot_signatures.Spots()
    a, b = s.signatures("the kite of the sea"), s.signatures("THE kite, of the sea")
    assert len(a) and (a == b).all()
    assert len(s.signatures("")) == 0 and len(s.signatures("%%")) == 1
    assert spot_signatures.likeness(s.signatures(""), s.signatures("")) == 1.0


def near_texts(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(words) for _ in range(60))
    texts = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = base[:]
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy) + (" " + common if r.random() < 0.2 else ""))
    hub = [r.choice(words) for _ in range(150)]
    for _ in range(150):
        copy = hub[:]
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(words)
        texts.append(" ".join(copy))
    return texts


def plain_components(docs):
    def tokens(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [tokens(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        t = top(i)
        if d is not None:
            least[t] = min(least.get(t, d), d)
    return sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("unit", [64, 8])
def test_components_equal_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(ngram_groups, "UNIT", unit)
    docs = [(i * 3 % 1009, t) for i, t in enumerate(near_texts())] + [(2001, None), (2002, " \n"), (2003, "ONE two"), (2004, "one  TWO"), (None, "one two"), (2003, "ONE two"), (2005, "a b c d e"), (2006, "a b c d e f " * 3000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, g string, n int")
    got = sorted((tuple(r) for r in ngram_groups.link_components(df).collect()), key=str)
    assert got == plain_components(docs)


def test_rows_without_or_with_one_id_meet_their_own_sets(spark):
    """Unlike texts under a null id, near copies under one id, and rows that repeat an id and a text very often."""
    near = near_texts()
    docs = [(None, t) for t in near] + [(5, t) for t in near[:200]] + [(6, near[0])] * 300 + [(None, near[1])] * 300
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in ngram_groups.link_components(df).collect()), key=str)
    assert got == plain_components(docs)


def test_texts_of_null_ids_grow_with_the_rows(spark):
    """Each row meets its own set alone: as many rows come back as there are sets."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("a text of its own"), F.col("id").cast("string"), F.lit("and"), (F.col("id") * 7).cast("string")).alias("text"))
    names, _ = ngram_groups.sketch(rows, "doc_id", "text")
    sets = ngram_groups.stands_for(names)
    assert ngram_groups.active_texts(rows, "doc_id", "text", sets, sets.select("s1", "s2")).count() == 20_000


def test_pairs_of_a_hot_token_equal_all_pairs(spark, monkeypatch):
    """A token in the prefixes of very many groups is dealt to several tasks; the pairs are those of one."""
    r = random.Random(2)
    matrix = [(1, g, r.randint(50, 70), 1) for g in range(400)] + [(t, g, 50 + g % 20, 1) for t in range(2, 40) for g in r.sample(range(400), 5)]
    sizes = {g: c for _, g, c, _ in matrix}
    matrix = [(t, g, sizes[g], m) for t, g, _, m in matrix]
    size_of = lambda c: int(ngram_groups.GROUP_SPREAD**c) + 1
    groups = spark.createDataFrame([(g, 1, size_of(c), size_of(c)) for g, c in sizes.items()], "g long, size long, n_min int, n_max int")
    frame = spark.createDataFrame(matrix, "token long, g long, size_class int, members long")
    got = {tuple(x) for x in ngram_groups.group_pairs(frame, groups).collect()}
    monkeypatch.setattr(ngram_groups, "hot_keys", lambda *a, **k: None)
    assert got == {tuple(x) for x in ngram_groups.group_pairs(frame, groups).collect()}
    shared = {}
    by = {}
    for t, g, _, _ in matrix:
        by.setdefault(t, []).append(g)
    for gs in by.values():
        for a, b in itertools.combinations(sorted(gs), 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    want = set()
    for (a, b), n in shared.items():
        small, large = sorted((size_of(sizes[a]), size_of(sizes[b])))
        if 100 * small >= 80 * large and n >= max(1.0, 4 / 9 * small - (0.8 - 4 / 9) * large - 2):
            want.add((a, b))
    assert got == want and want


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_groups.link_components(df).count() == 0
    assert ngram_groups.link_components(spark.createDataFrame([(1, "only one")], df.schema)).collect()[0]["component_id"] == 1


def labelled(spark, n=400):
    r = random.Random(1)
    plain = "river stone cloud lamp paper green window table song bread".split()
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["rotten", "vermin"]))
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["coupon", "lottery"]))
        docs.append((i, " ".join(words), "k"))
        labels.append((i, 1 if i % 5 else 0, int(bad)))
    docs += [(n, None, "k"), (n + 1, "", "k"), (None, "vermin", "k"), (1, docs[1][1], "k")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    known = [r for r in rows if truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known if r["held_out"]]) > 0.97
    assert len(rows) == 404
    long = spark.createDataFrame([(500, "river " * 200_000 + "vermin", "k"), (501, "river " * 200_000, "k")], docs.schema)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(long, toxicity.fit(docs, labels)).collect()} == {500: 1, 501: 0}
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 0").count() == 0 and left.where("doc_id = 1").count() == 2


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 20)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0}
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_counterfactuals_spare_neutral_mentions():
    # Feature 0 is an identity term that mostly comes with abuse (feature 1), feature 2 another of its kind.
    rows = [as_bytes(r) for r in [[0, 1]] * 40 + [[1]] * 5 + [[2]] * 30 + [[]] * 40 + [[0]] * 2]
    y = np.array([1] * 45 + [0] * 72)
    pairs = [(as_bytes(a), as_bytes(b)) for a, b in [([0, 1], [1, 2])] * 40 + [([2], [0])] * 30]
    plain, b0 = toxicity.fit_rows(rows, y, [], 3, counterfactual=0.0)
    fair, b1 = toxicity.fit_rows(rows, y, pairs, 3)
    assert abs(fair[0] - fair[2]) < 0.2 * abs(plain[0] - plain[2])
    assert b1 + fair[0] < 0 < b1 + fair[0] + fair[1]
    swap = toxicity.swaps(toxicity.IDENTITIES)
    assert toxicity.swapped("The Women spoke.", swap) == "The men spoke." and toxicity.swapped("nobody", swap) is None


def test_learnt_terms_change_scores_less(spark):
    """Terms of the tables themselves: their swaps move the scores of held-out rows less than without the penalty."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")), "toxic").collect()
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    change, right = [], []
    for weight in (0.0, 20.0):
        model = toxicity.fit(docs, labels, counterfactual=weight)
        assert model.pairs > 100 and len(model.swap) > 100
        score = model.scorer()
        both = [(score(t), score(o)) for t, _ in held if (o := toxicity.swapped(t, model.swap)) is not None]
        change.append(np.mean([abs(a - b) for a, b in both]))
        right.append(np.mean([(score(t) >= 0.5) == bool(y) for t, y in held]))
    assert len(both) > 20 and change[1] < 0.7 * change[0] and right[1] > 0.95


def mentions(n=900):
    """Sentences that name groups, listed ones and ones of this corpus alone: one of each kind mostly beside abuse, the others mostly not."""
    r = random.Random(11)
    plain, abuse = "river stone cloud lamp paper green window table song bread".split(), ["rotten", "vermin", "filthy"]
    kinds = {"people": ["muslims", "christians", "jews", "hindus"], "folk": ["zorgs", "plims", "dravs", "kelts"], "tools": ["spade", "rake", "hoe", "axe"]}
    frames = {"people": "all the {} who came", "folk": "a few {} from afar", "tools": "with one {} in hand"}
    docs, labels = [], []
    for i in range(n):
        kind = r.choice(list(kinds))
        toxic = r.random() < 0.4 and kind != "tools"
        blamed = r.random() < (0.9 if toxic else 0.12)
        term = kinds[kind][0] if blamed else r.choice(kinds[kind][1:])
        words = r.choices(plain, k=r.randint(4, 14))
        if toxic and r.random() < 0.5:
            words.insert(0, r.choice(abuse))
        docs.append((i, f"{' '.join(words[:3])} {frames[kind].format(term)} {' '.join(words[3:])}"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_neutral_mentions_are_rejected_less(spark):
    """On held-out clean rows that name a group, the penalty takes away false alarms."""
    docs, labels = mentions()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.fit(d, y, counterfactual=w) for w in (0.0, 20.0))
    before, after = (toxicity.neutral_mentions(d, y, m).first() for m in (plain, fair))
    assert before["mentions"] > 40 and before["mentions_rejected"] > 0
    assert after["mentions_rejected"] < 0.5 * before["mentions_rejected"]
    assert set(fair.swap) >= toxicity.LISTED


def test_kinds_follow_contexts(spark):
    docs, _ = mentions()
    sample = spark.createDataFrame([(t, "0") for _, t in docs] + [("", "0")], "text string, y string")
    terms = ["zorgs", "spade", "muslims", "plims", "rake", "christians", "dravs", "hoe", "jews", "kelts", "axe", "hindus"]
    kinds = toxicity.kinds_by_context(terms, toxicity.neighbours(sample, terms))
    assert {frozenset(k) for k in kinds} == {frozenset(k) for k in (["zorgs", "plims", "dravs", "kelts"], ["spade", "rake", "hoe", "axe"], ["muslims", "christians", "jews", "hindus"])}
    assert toxicity.kinds_by_context(["a"], []) == [] and toxicity.kinds_by_context(["a", "b", "c"], []) == [("a", "b", "c")]
    assert toxicity.neighbours(sample, []) == []


def plain_scores(docs, labels, weight, l2=0.005):
    """The fit and all scores anew, with dense matrices and plain gradient descent, from the model's terms and features alone."""
    import tarn.llm.linear as linear

    def features(text, known):
        words = set(re.findall(r"\w+", text.lower()))
        return [f for w in words for f in {f"w:{w}", *(f"p:{w[:k]}" for k in linear.PREFIXES if len(w) >= k)} if f in known]

    def run(model):
        at = {f: i for i, f in enumerate(model.features)}
        row = lambda t: np.bincount([at[f] for f in set(features(t, at))], minlength=len(at)).astype(float)
        truth = dict(labels)
        train = [(t, truth[d]) for d, t in docs if d in truth and zlib.crc32(str(d).encode()) % 5]
        x, y = np.array([row(t) for t, _ in train]), np.array([v for _, v in train])
        n1 = y.sum()
        w8 = np.where(y == 1, np.sqrt((len(y) - n1) / n1), 1.0)
        w8 /= w8.sum()
        other = []
        for i, (t, _) in enumerate(train):
            swapped = re.sub(r"\w+", lambda m: model.swap.get(m[0].lower(), m[0]), t)
            if any(m.lower() in model.swap for m in re.findall(r"\w+", t)):
                other.append(x[i] - row(swapped))
        d = np.array(other) if other else np.zeros((1, len(at)))
        p, b = np.zeros(len(at)), 0.0
        hessian = lambda s: np.block([[x.T @ (x * s[:, None]) + l2 / 10 * np.eye(len(at)) + 2 * weight / len(d) * d.T @ d, (x.T @ s)[:, None]], [(x.T @ s)[None, :], np.array([[s.sum()]])]])
        for _ in range(60):
            q = 1 / (1 + np.exp(-(x @ p + b)))
            g = np.append(x.T @ ((q - y) * w8) + l2 * p / 10 + 2 * weight / len(d) * d.T @ (d @ p), ((q - y) * w8).sum())
            step = np.linalg.lstsq(hessian(q * (1 - q) * w8), g, rcond=None)[0]
            p, b = p - step[:-1], b - step[-1]
        return {i: 1 / (1 + np.exp(-(row(t) @ p + b))) for i, t in docs}

    return run


@pytest.mark.parametrize("weight", [0.0, 20.0])
def test_scores_equal_a_plain_fit(spark, weight):
    docs, labels = mentions(300)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y, counterfactual=weight)
    want = plain_scores(docs, labels, weight)(model)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 2e-3


def test_labelled_rows_are_bounded(spark):
    from tarn.llm.linear import labelled_sample

    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, "x") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, F.col("toxic"), 30)
    assert sample.count() == 30 and sample.where("text <> 'x'").count() <= 1


def test_rates_meet_targets(spark):
    r = random.Random(2)
    members = [(i, r.choice([0, 5, 50, 500]), [p := r.random(), 1 - p]) for i in range(500)]
    df = spark.createDataFrame(members, "doc_id long, tokens long, p array<double>")
    history, reached, goal = mixing.fit_rates(df, ["a", "b"], {"a": 0.75, "b": 0.25})
    total = sum(m[1] for m in members)
    assert np.allclose(goal, [0.75 * total, 0.25 * total]) and np.abs(reached - goal).max() <= 1e-3 * total
    rate = np.ones(500)
    p = np.array([m[2] for m in members])
    for step in history:
        rate = np.maximum(rate - p @ step, 0)
    assert np.allclose((rate * [m[1] for m in members]) @ p, reached) and (rate >= 0).all()


def test_missed_targets_are_told(spark):
    df = spark.createDataFrame([(i, 10, [1.0, 0.0]) for i in range(50)] + [(99, 0, [0.5, 0.5])], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="no rates reach"):
        history, reached, goal = mixing.fit_rates(df, ["a", "b"], {"a": 0.5, "b": 0.5})
    rates = [r["rate"] for r in df.select(mixing.rate_column(history).alias("rate")).collect()]
    assert all(r >= 0 for r in rates) and reached[1] == 0 and goal[1] == 250 and abs(reached[0] - 250) < 1


def soft_members(seed, n=300, k=4):
    r = np.random.default_rng(seed)
    return [(i, int(t), (x / x.sum()).tolist()) for i, (t, x) in enumerate(zip(r.choice([0, 5, 50, 500], n), r.dirichlet([3.0, 1.0, 0.3, 0.1], n) + 1e-4, strict=True))]


@pytest.mark.parametrize("weights", [(0.6, 0.25, 0.1, 0.05), (0.3, 0.3, 0.3, 0.1), (0.05, 0.05, 0.1, 0.8), (0.01, 0.01, 0.01, 0.97)])
def test_rates_are_the_optimum(spark, weights):
    """Targets near the present shares and far from them, against plain projected-gradient least squares."""
    members = soft_members(4)
    df = spark.createDataFrame(members, "doc_id long, tokens long, p array<double>").coalesce(1).cache()
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        history, reached, goal = mixing.fit_rates(df, list("abcd"), dict(zip("abcd", weights, strict=True)))
    t, p = np.array([m[1] for m in members], dtype=float), np.array([m[2] for m in members])
    rate = np.ones(len(t))
    for step in history:
        rate = np.maximum(rate - p @ step, 0)
    assert np.allclose((rate * t) @ p, reached)
    metric = np.linalg.inv((p * t[:, None]).T @ p)
    a = (p * t[:, None]).T / t.sum()
    plain, ahead, momentum = np.ones(len(t)), np.ones(len(t)), 1.0
    scale = np.linalg.norm(np.linalg.cholesky(metric).T @ a * t.sum(), 2) ** 2
    for _ in range(20_000):
        new = np.maximum(ahead - (a * t.sum()).T @ (metric @ ((a * t.sum()) @ ahead - goal)) / scale, 0)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, plain, momentum = new + (momentum - 1) / after * (new - plain), new, after
    distance = lambda got: (got - goal) @ metric @ (got - goal)
    assert distance(reached) <= distance((plain * t) @ p) + 1e-5 * (goal @ metric @ goal)
    if weights[0] >= 0.3:  # these some rates reach
        assert np.abs(reached - goal).max() <= 1e-6 * t.sum()


def test_rates_meet_targets_closely(spark):
    members = soft_members(7)
    df = spark.createDataFrame(members, "doc_id long, tokens long, p array<double>").coalesce(1).cache()
    _, reached, goal = mixing.fit_rates(df, list("abcd"), {"a": 0.75, "b": 0.19, "c": 0.05, "d": 0.01})
    assert np.abs(reached - goal).max() <= 1e-5 * sum(m[1] for m in members)


def test_mixing_whole_table(spark):
    docs, labels = labelled(spark)
    rated, mix = mixing.mixed(docs, labels)
    rows, domains = rated.collect(), mix.domains
    assert np.abs(mix.reached - mix.targets).max() <= 1e-6 * mix.targets.sum()
    assert len(rows) == docs.count() and all(x["rate"] >= 0 and x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in rows)
    assert all(abs(sum(x["p"]) - 1) < 1e-9 and len(x["p"]) == len(domains) for x in rows)
    assert mixing.mixed_documents(docs, labels).columns == docs.columns
    assert mixing.mixed_documents(docs.limit(0), labels).count() == 0
    assert {x["rate"] for x in mixing.mixed(docs, labels.limit(0))[0].collect()} == {1.0}


def test_mixing_by_quality_null_ids_and_long_texts(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, f"river {i}", "k") for i in range(40)] + [(9_000_001, "word " * 200_000, "k")], docs.schema)
    rated, mix = mixing.mixed(docs.union(odd), labels, {"q1": 0.3, "q0": 0.7}, domain=mixing.domain_of(q="quality"))
    rows = rated.collect()
    assert mix.domains == ["q0", "q1"] and len(rows) == docs.count() + 41
    assert len({x["share"] for x in rows if x["doc_id"] is None}) == 41
    assert max(x["tokens"] for x in rows) == 200_000
    total = sum(x["expected_tokens"] for x in rows)
    assert abs(sum(x["expected_tokens"] * x["p"][0] for x in rows) / total - 0.7) < 1e-5


def test_rare_and_unseen_domains_keep_their_targets(spark):
    docs, labels = labelled(spark)
    # The first is a training row; the other has no text.
    more = spark.createDataFrame([(10003, 7, 0), (10_002, 8, 0)], "doc_id long, quality int, toxic int")
    rare = spark.createDataFrame([(10003, "an odd rare text", "k")], docs.schema)
    model = mixing.fit_domains(docs.union(rare), labels.union(more))
    assert model.domains == ["q0t0", "q0t1", "q1t0", "q1t1", "q7t0", "q8t0"]
    p = model.posteriors()("an odd rare text")
    assert p[4] > 0 and p[5] == 0 and abs(p.sum() - 1) < 1e-9
    weights = {"q1t0": 0.6, "q0t0": 0.2, "q1t1": 0.1, "q0t1": 0.05, "q7t0": 0.01, "q8t0": 0.04}
    _, reached, goal = mixing.fit_rates(mixing.written(mixing.memberships(docs.union(rare), model), "memberships"), model.domains, weights)
    assert np.allclose(goal / goal.sum(), [weights[d] for d in model.domains]) and reached[5] == 0
    assert np.abs(reached - goal)[5] == goal[5]


def test_sparse_rows():
    x = Rows([as_bytes(r) for r in ([0, 2], [], [1])], 3)
    assert x.times(np.array([1.0, 2.0, 4.0])).tolist() == [5.0, 0.0, 2.0]
    assert x.transposed_times(np.array([1.0, 1.0, 3.0])).tolist() == [1.0, 3.0, 1.0]


def test_near_pairs(spark):
    texts = near_texts(9)[:120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = spot_signatures.Spots()
    sets = [s.signatures(t) for t in texts]
    by = {}
    for i, x in enumerate(sets):
        by.setdefault(x.tobytes(), i)
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(by.values(), 2) if spot_signatures.likeness(sets[a], sets[b]) >= 0.8}
    got = {tuple(sorted((r["a"], r["b"]))) for r in spot_signatures.near_pairs(spot_signatures.fingerprints(df)).collect()}
    assert got == want


def test_words_of_equal_sums_are_told_apart(spark):
    """Words that polynomial hashes modulo a power of two confuse: a sequence of a and b, and the one with both swapped."""
    word = "a"
    for _ in range(9):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = ["one two three four five", *(f"{w} is a word that hashes may well confuse" for w in (word, word.translate(str.maketrans("ab", "ba"))))]
    got = ngram_groups.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got)
    assert ngram_groups.real_shingles("A b\tC d e f") == {(b"a", b"b", b"c", b"d", b"e"), (b"b", b"c", b"d", b"e", b"f")}
    assert ngram_groups.real_shingles(" A  b") == {(b"a", b"b")} and not ngram_groups.real_shingles(" \n")


def test_components_of_hot_labels(spark):
    """Many links into one node, and a chain behind it."""
    links = [(i, i, 0, 0) for i in range(1, 900)] + [(i, 0, i + 1, 0) for i in range(1000, 1040)] + [(1000, 0, 5, 5)] + [(5000 + i, 0, 6000, 0) for i in range(3)]
    got = {(r["s1"], r["s2"]): tuple(r["label"]) for r in ngram_groups.components(spark.createDataFrame(links, "a1 long, a2 long, b1 long, b2 long")).collect()}
    assert len(got) == 900 + 41 + 4
    assert {v for k, v in got.items() if k[0] < 5000} == {(0, 0)} and {v for k, v in got.items() if k[0] >= 5000} == {(5000, 0)}


def test_links_are_found_once(spark, tmp_path):
    kind = "a1 long, a2 long, b1 long, b2 long"

    def found(batches):
        for b in batches:
            (tmp_path / uuid.uuid4().hex).write_text(str(len(b)))
            yield b

    links = spark.createDataFrame([(1, 1, 2, 2), (3, 3, 2, 2), (5, 5, 5, 5), (8, 8, 7, 7)], kind).coalesce(1).mapInPandas(found, kind)
    got = {(r["s1"], r["s2"]): tuple(r["label"]) for r in ngram_groups.components(links).collect()}
    assert got == {(1, 1): (1, 1), (2, 2): (1, 1), (3, 3): (1, 1), (7, 7): (7, 7), (8, 8): (7, 7)}
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 4
