"""Ranked search, fill-in-middle and language prediction against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import fim, lexical, ppm

BIG = 1 << 60
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# -- ranked search -----------------------------------------------------------------------------------------------


def plain_search(docs, items, top):
    bags = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs if t and TERM.search(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            n = sum(b.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            score = 0
            for w in TERM.findall(lowered(text or "")):
                if b[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * b[w]) // (1000 * b[w] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return out


@pytest.mark.parametrize("seed,bucket,share", [(1, 512, 0.02), (2, 7, 0.3), (3, 3, 0.9)])
def test_search_equals_all_scores(spark, monkeypatch, seed, bucket, share):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "FIRST_SHARE", share)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 16_384 if seed < 3 else 2)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Él", "über", "ÄB", "naïve", "日本", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    say = lambda n: r.choice([" ", "-", "\n"]).join(r.choices(words, weights, k=n))
    docs = [(BIG + i * 3, say(r.randint(1, 60))) for i in range(300)]
    docs += [(BIG + 7, docs[5][1]), (BIG + 8, docs[5][1]), (None, docs[5][1]), (5, None), (6, ""), (7, "-- !"), (8, "W1 w1 W1"), (9, say(20_000))]
    items = [(i, say(r.randint(1, 12))) for i in range(12)] + [(20, None), (21, "!!"), (22, "unknown"), (23, "w1 w1 w1"), (23, "Él w2")]
    got = lexical.search(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3),
        spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, rank int"), 20,
    )
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(docs, items, 20), key=str)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).count() == 1
    assert lexical.search(docs, spark.createDataFrame([(1, "zz")], "item_id long, text string")).count() == 0


def test_buckets_and_coordinates_leave_documents_out():
    """With a high bound a bucket is not looked at, and of another only the documents that a rare term lifts over it."""
    block = lexical.Block([0], {b"common": 0, b"rare": 1}, [np.array([0, 1])], [np.array([1, 1])])
    search = lexical.Search(block, np.array([1, 9]), np.array([50.0]), 3)
    lengths = np.array([8.0, 8.0, 6.0])
    at, terms, impact = np.array([0, 1, 2, 3]), np.array([0, 1, 1]), np.array([8, 8, 6])
    assert search.bucket(lengths, np.array([1, 2, 3]), np.zeros(3, bool), at, terms, impact)
    assert search.best[0][2].tolist() == [2, 3]
    assert not search.bucket(np.array([5.0]), np.array([4]), np.zeros(1, bool), np.array([0, 1]), np.array([1]), np.array([5]))


# -- fill-in-middle ----------------------------------------------------------------------------------------------


def plain_form(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "é日😀\nñ\n\nlast", "with <P> in it\nx", "<M>", "ends with <\n<S\nP>\n", "x" * 100_000, "line\n" * 50_000, "a\r\nb\rc\n", "\x00\n\x00"]


def test_fill_in_middle_equals_the_plain_form(spark):
    r = random.Random(4)
    texts = FIM_TEXTS + ["".join(r.choice("ab<SPM>\né😀") for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = [(BIG + i if i % 2 else i, t) for i, t in enumerate(texts)] + [(None, "a\nb"), (None, "a\nb"), (3, "c\nd"), (3, "c\nd")]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, output string")
    got = fim.restore(fim.fill_in_middle(df)).collect()
    key = lambda x: str(x)
    assert sorted([tuple(g) for g in got], key=key) == sorted([(d, *plain_form(d, t or ""), t or "") for d, t in rows], key=key)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0
    only = fim.fill_in_middle(df, fim.Plan(rate=0)).collect()
    assert {g["form"] for g in only} == {"plain"} and all(g["output"] is not None for g in only)


def test_rotation_and_bad_outputs():
    b = bytearray(b"abcdefg")
    fim.rotate(b, 1, 3, 6)
    assert b == b"adefbcg"
    for output, form in ((b"text", "psm"), (b"<P>a<S>b<M>c", "spm"), (b"<S>a<P>b", "spm"), (b"<P>a<S>b<M>c", "odd")):
        with pytest.raises(ValueError, match="no output"):
            fim.restored(output, form)


def test_null_outputs_stay_null(spark):
    df = spark.createDataFrame([(1, None, "psm"), (2, "<P><S><M>x", "psm")], "k long, output string, form string")
    assert [(r["k"], r["restored"]) for r in fim.restore(df).orderBy("k").collect()] == [(1, None), (2, "x")]


# -- language ----------------------------------------------------------------------------------------------------


def plain_bits(text, counts, order):
    """Prediction by partial matching as it is written: the longest known context, escapes of method C, exclusion."""
    data, total = bytes([ppm.PAD]) * order + text, 0.0
    for i in range(order, len(data)):
        out, escaped = set(), False
        for size in range(order, -1, -1):
            own = counts.get(data[i - size : i])
            if own is None:
                continue
            own = {s: n for s, n in own.items() if s not in out}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if data[i] in own:
                total += math.log2(whole / own[data[i]])
                escaped = True
                break
            total += math.log2(whole / len(own))
            out |= own.keys()
        if not escaped:
            total += math.log2(256 - len(out))
    return total


def kept_counts(texts, order, contexts, least):
    counts = {}
    for t in texts:
        data = bytes([ppm.PAD]) * order + t
        for i in range(order, len(data)):
            for size in range(order + 1):
                counts.setdefault(data[i - size : i], Counter())[data[i]] += 1
    seen = sorted((-sum(c.values()), len(k), k) for k, c in counts.items() if sum(c.values()) >= least or not k)
    return {k: counts[k] for _, _, k in seen[:contexts]}


TONGUES = {"aa": "the cat sat on the mat and the dog ran", "bb": "le chat est assis sur le tapis bleu été", "cc": "der hund läuft über die straße und weiter"}


@pytest.mark.parametrize("order,contexts,least,segment", [(4, 100_000, 1, 1 << 18), (2, 100_000, 3, 5000), (4, 60, 2, 1 << 18), (0, 10, 1, 1 << 18)])
def test_code_lengths_equal_the_plain_method(spark, monkeypatch, order, contexts, least, segment):
    monkeypatch.setattr(ppm, "SEGMENT", segment)
    r = random.Random(6)
    say = lambda lang, n: " ".join(r.choices(TONGUES[lang].split(), k=n))
    train = [(lang, say(lang, r.randint(3, 40))) for lang in TONGUES for _ in range(6)]
    got = ppm.context_counts(ppm.grams(spark.createDataFrame(train, "lang string, text string"), order), order, contexts, least).collect()
    model = ppm.build([(g["lang"], bytes(g["context"]), g["symbol"][0], g["n"]) for g in got], order)
    tests = [say(lang, 20).encode() for lang in TONGUES] + [b"", b"x", "日本 zzz \x00".encode(), bytes(r.randrange(256) for _ in range(300)), say("bb", 4000).encode()]
    lengths = model.code_lengths(tests)
    for li, lang in enumerate(model.languages):
        counts = kept_counts([t.encode() for x, t in train if x == lang], order, contexts, least)
        for t, row in zip(tests, lengths, strict=True):
            assert row[li] == pytest.approx(plain_bits(t, counts, order), rel=1e-9, abs=1e-9)


def test_hash_table_finds_all_keys_and_no_others():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 40, 5000)).astype(np.uint64)
    table = ppm.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(r.integers(0, 1 << 40, 5000).astype(np.uint64), keys)
    assert (table.find(others) == -1).all()
    assert (ppm.Table(np.empty(0, np.uint64)).find(keys) == -1).all()


def labelled(n=90, seed=3):
    r = random.Random(seed)
    return [(i if i % 5 else BIG + i, " ".join(r.choices(TONGUES[lang].split(), k=r.randint(5, 40))), lang) for i in range(n) for lang in [r.choice(list(TONGUES))]]


def test_languages_are_predicted_from_text_alone(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.fit(df)
    got = {r["doc_id"]: r for r in ppm.predict(df, model).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang in rows)
    assert {d for d, r in got.items() if r["held_out"]} == {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1}
    # Labels of held-out rows, other columns and the order of rows change nothing.
    changed = df.withColumn("lang", F.when(ppm.is_held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("score", F.lit("x")).orderBy(F.desc("text"))
    again = {r["doc_id"]: r for r in ppm.predict(changed, ppm.fit(changed)).collect()}
    assert {d: (r["lang_pred"], r["bits"]) for d, r in again.items()} == {d: (r["lang_pred"], r["bits"]) for d, r in got.items()}


def test_odd_texts_and_tables_of_languages(spark):
    rows = labelled() + [(None, "the cat sat", "zz"), (1000, "the cat sat on the mat", None)]
    model = ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(TONGUES)
    odd = [(BIG + 1, None), (None, "der hund und die straße"), (BIG + 3, ""), (2, "12 !? \n"), (3, "١٢"), (4, "the dog " * 50_000), (5, "le tapis"), (5, "le tapis"), (6, "é")]
    df = spark.createDataFrame([(*x, "aa") for x in odd], "doc_id long, text string, bits string").repartition(1)
    got = sorted(ppm.predict(df, model).collect(), key=str)
    assert sorted([r["doc_id"] for r in got], key=str) == sorted([d for d, _ in odd], key=str)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 and by[d]["bits"] is None for d in (BIG + 1, BIG + 3, 2, 3))
    assert by[None]["lang_pred"] == "cc" and not by[None]["held_out"] and by[4]["lang_pred"] == "aa" and by[5]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert ppm.predict(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in ppm.predict(df, ppm.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_training_rows_are_bounded(spark):
    copies = [(i, "the cat sat", "aa") for i in range(200)] + [(7, f"le chat {i}", "bb") for i in range(50)] + [(7, "le chat 1", "bb")] * 30
    got = ppm.training_texts(spark.createDataFrame(copies, "doc_id long, text string, lang string"), bound=10).groupBy("lang").count().collect()
    held = zlib.crc32(b"7") % 3 == 1
    assert {r["lang"]: r["count"] for r in got} == ({"aa": 1} if held else {"aa": 1, "bb": 10})
