"""Likeness to earlier artifacts without all pairs, and summaries in levels."""

import datetime
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn import evidence_queries
from tarn.functions.term_words import clean_term
from tarn.operators import agent, fusion
from tarn.plans import enrich, ingest, retrieve
from tarn.providers import Offline
from tarn.queries import ORACLE_SQL


def plain_uniqueness(turns):
    out = {}
    for k, t, own in turns:
        earlier = [set(o or ()) for k2, t2, o in turns if k2 == k and t2 < t]
        mine = set(own or ())
        best = max((len(mine & e) / len(mine | e) for e in earlier if e), default=0.0)
        out[k, t] = 1.0 if not earlier else 0.5 if not mine else 1 - best
    return out


@pytest.mark.parametrize("seed", range(4))
def test_uniqueness_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    turns = []
    for k in range(5):
        for t in range(r.randint(1, 40)):
            if t and r.random() < 0.4:
                own = [w for w in r.choice([x for x in turns if x[0] == k] or [(0, 0, ["w1"])])[2] or () if r.random() < 0.9] + r.sample(words, r.randint(0, 2))
            else:
                own = r.sample(words, r.randint(0, 12))
            turns.append((k, t, None if r.random() < 0.05 else own))
    df = spark.createDataFrame(turns, "conv long, turn long, own array<string>")
    got = {(x["conv"], x["turn"]): x["uniqueness"] for x in agent.uniqueness_of(df, "conv", "turn", "own").collect()}
    want = plain_uniqueness(turns)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_uniqueness_of_a_long_run_and_of_nothing(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv"), F.col("id").alias("turn"), F.array(F.lit("common"), F.concat(F.lit("a"), F.col("id").cast("string")), F.concat(F.lit("b"), F.floor(F.col("id") / 2).cast("string"))).alias("own"))
    got = {x["turn"]: round(x["uniqueness"], 6) for x in agent.uniqueness_of(turns, "conv", "turn", "own").collect()}
    assert len(got) == 3000 and got[0] == 1.0 and all(got[i] == (0.5 if i % 2 else 0.8) for i in range(1, 3000))
    assert agent.uniqueness_of(turns.limit(0), "conv", "turn", "own").count() == 0


def first_words(n):
    return lambda c: F.array_join(F.slice(F.split(c, r"\s+"), 1, n), " ")


def plain_levels(texts, limit, keep):
    """(summary, levels, calls, error) of one document, group by group."""
    level, calls = 0, 0
    while True:
        level += 1
        if max(len(t.split()) for t in texts) > limit:
            return "", level, calls, "too large"
        groups, used = [[]], 0
        for t in texts:
            if groups[-1] and used + len(t.split()) > limit:
                groups.append([])
                used = 0
            groups[-1].append(t)
            used += len(t.split())
        if level > 1 and len(groups) > 1 and len(groups) >= len(texts):
            return "", level, calls, "no fewer"
        calls += len(groups)
        texts = [" ".join(" ".join(g).split()[:keep]) for g in groups]
        if len(groups) == 1:
            return texts[0], level, calls, None


def test_documents_of_several_levels(spark, tmp_path):
    r = random.Random(2)
    docs = {d: [" ".join(r.choices("tide boat sail harbour rope".split(), k=r.randint(3, 12))) for _ in range(n)] for d, n in (("one", 2), ("two", 8), ("three", 60), ("four", 300))}
    docs["large"] = ["few words here", "too " * 40]
    rows = [(d, i, "content", 50, t) for d, ts in docs.items() for i, t in enumerate(ts)] + [("none", 0, "code", 50, "x = 1"), ("short", 0, "content", 3, "a b c"), (None, 0, "content", 50, "of no one")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_type string, tokens int, text string")
    got = {x["doc_id"]: x for x in enrich.hierarchical_summaries(chunks.where("doc_id IS NOT NULL"), "doc_id", str(tmp_path), window=40, output=6, prompt=4, summarise=first_words(6)).collect()}
    assert got.keys() == set(docs)
    for d, texts in docs.items():
        summary, levels, calls, error = plain_levels(texts, 30, 6)
        assert (got[d]["summary"], got[d]["levels"], got[d]["calls"], got[d]["error"] is None) == (summary, levels, calls, error is None)
    assert got["three"]["levels"] == 3 and got["four"]["levels"] >= 3 and "exceeds the request" in got["large"]["error"]


def test_levels_that_end_without_a_summary(spark, tmp_path):
    chunks = spark.createDataFrame([("a", i, "content", 50, "tide boat sail rope " * 4) for i in range(4)], "doc_id string, chunk_index int, chunk_type string, tokens int, text string")
    got = enrich.hierarchical_summaries(chunks, "doc_id", str(tmp_path / "a"), window=30, output=5, prompt=5, summarise=lambda c: F.lit("")).first()
    assert (got["summary"], got["error"]) == ("", "no usable summary")
    same = enrich.hierarchical_summaries(chunks, "doc_id", str(tmp_path / "b"), window=30, output=5, prompt=5, summarise=lambda c: c).first()
    assert same["error"] == "summaries do not get fewer"
    with pytest.raises(ValueError, match="no room"):
        enrich.hierarchical_summaries(chunks, "doc_id", str(tmp_path / "c"), window=10, output=5, prompt=5)
    assert enrich.hierarchical_summaries(chunks.limit(0), "doc_id", str(tmp_path / "d"), Offline()).count() == 0


def test_fused_contributions_tell_the_later_place(spark):
    hits = spark.createDataFrame([("dense", "a", 1), ("dense", "a", 3), ("sparse", "a", 2)], "source string, id string, rank int")
    r = fusion.rank_fused(hits, ["id"]).first()
    assert abs(r["rrf"] - (1 / 61 + 1 / 63 + 0.9 / 62)) < 1e-12 and abs(r["contributions"]["dense"] - 1 / 63) < 1e-12


def test_retrieval_within_a_time_and_by_a_draft(spark):
    docs = spark.createDataFrame([("a", "The ferry ran in spring over the bay to the old pier."), ("b", "The ferry ran in autumn over the bay to the new pier."), ("c", "Bread with rye and salt from the oven.")], "doc_id string, text string")
    provider = Offline(dim=32)
    index = ingest.index_chunks(docs, provider=provider).withColumn("embedding", provider.embed(F.col("embed_text"))).cache()
    day = lambda m: datetime.datetime(2024, m, 10)
    table = spark.createDataFrame([("a", day(3), day(3)), ("b", day(9), day(9)), ("c", day(3), day(3))], "doc_id string, created_at timestamp, updated_at timestamp")
    dates = spark.createDataFrame([("b", "0", day(3))], "doc_id string, chunk_id string, date_value timestamp")
    base = F.lit("2024-10-01 12:00:00").cast("timestamp")
    ask = "when did the ferry run in march 2024"
    vector = spark.range(1).select(provider.embed(F.lit(ask)).alias("v")).first()["v"]
    scope = retrieve.date_scope(spark, ask, base, "UTC", dates, table)
    assert sorted(map(tuple, scope.collect())) == [("a", "*"), ("b", "0"), ("c", "*")]
    september = retrieve.date_scope(spark, "the ferry of september", base, "UTC", dates, table)
    assert sorted(map(tuple, september.collect())) == [("b", "*")] and retrieve.date_scope(spark, "the ferry", base, "UTC", dates, table) is None
    got = retrieve.retrieve(index, ask, vector, provider=provider, identities=september)
    assert {r["doc_id"] for r in got.hits.select("key.doc_id").collect()} == {"b"}
    sources = lambda draft: {s for r in retrieve.retrieve(index, ask, vector, provider=provider, draft=draft).hits.select("contributions").collect() for s in r["contributions"]}
    assert "hyde" in sources("The ferry ran to the pier.") and "hyde" not in sources("It ran 17 times.") and "hyde" not in sources(None)


@pytest.mark.parametrize(
    "phrase,want",
    [
        ("the red kite of", "red kite"), ("of the", None), ("the", None), ("thing", None), ("kite", "kite"), ("har- bour wall", "harbour wall"), ("a b", "b"), ("| keel | oak |", "keel oak"),
        ("|---|:--|", None), ("---", None), ("one two three four five", "one two three four"), ("they made the boat", "they made the boat"), ("made the boat about it", "boat"), ("cross-", None), ("", None), (None, None), ("  big   red\nsail ", "big red sail"),
    ],
)
def test_terms_of_phrases(spark, phrase, want):
    got = spark.range(1).select(clean_term(F.lit(phrase).cast("string")).alias("t")).first()["t"]
    assert got == (want if want != "b" else None)


@pytest.mark.parametrize(
    "phrase,want",
    [
        ("har- b- our wall", "harb- our wall"), ("x_- 1- sea", "x_1- sea"), ("\u203f- kite", "\u203f- kite"), ("\xb2- kite", "\xb2kite"), ("red\xa0kite of", "red\xa0kite"), ("\xa0 red kite\u3000", "red kite"),
        ("\u2028 kite", "\u2028 kite"), ("\u0130s red kite", "red kite"), ("--- \x85", "--- \x85"), ("| keel | oak |", "keel oak"), ("|---|:--|", None), ("cross-", None), ("", None), (None, None),
    ],
)
def test_terms_of_spaced_phrases(spark, phrase, want):
    got = spark.range(1).select(clean_term(F.lit(phrase).cast("string"), spaced=True).alias("t")).first()["t"]
    assert got == want


def test_cleaned_terms_equal_their_sql_on_odd_words(spark, tmp_path):
    texts = ["a- b- case of- the way", "red _- 1- in kite", "x\xa0y of\u2028 q\u2028| z", "\u3000z kite \xa0", "\u0130s kite- \u203f- \xb2- m", "--- \x85", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = evidence_queries.cleaned_terms(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["cleaned_terms"]).fetchall())


def test_keywords_are_asked_for_again(spark, tmp_path):
    """Batches that are answered in full, in part, only at the second time, never, and by a broken reply."""
    chunks = [("full", 2), ("part", 3), ("late", 2), ("never", 1), ("broken", 2), ("slow", 2)]
    rows = [(d, str(i), i, "content", 5, f"text {i} of {d}") for d, n in chunks for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id string, chunk_index int, chunk_type string, tokens int, text string")
    folder = str(tmp_path / "asked")
    os.mkdir(folder)

    def reply(request):
        """One file a request counts how often it came."""
        items = json.loads(request)
        name = items[0]["text"].split()[-1]
        seen = len([f for f in os.listdir(folder) if f.startswith(name + ".")])
        with open(f"{folder}/{name}.{seen}", "w") as f:
            f.write(request)
        every = [{"chunk_id": x["chunk_id"], "keywords": [f"{name}{x['chunk_id']}", "Two  words", "two words", "third"]} for x in items]
        if name == "never" or name in ("late", "slow") and seen == 0:
            return None if name == "late" else "no json"
        if name == "part" and seen == 0 or name == "slow" and seen == 1:
            return json.dumps(every[:1] + [{"chunk_id": "77", "keywords": ["alien"]}])
        if name == "broken":
            return "{oops " + json.dumps(every[0]) + ", {" + json.dumps(every[1])
        return json.dumps(every)

    ask = lambda c: F.pandas_udf(lambda s: s.map(reply), "string")(c)
    got = {(r["doc_id"], r["chunk_id"]): (r["keywords"], r["calls"]) for r in enrich.asked_keywords(df, "doc_id", str(tmp_path / "work"), ask, keep=2).collect()}
    assert len(got) == len(rows)
    for d, n in chunks:
        calls = {"full": 1, "part": 2, "late": 2, "never": 2, "broken": 1, "slow": 3}[d]
        for i in range(n):
            assert got[d, str(i)] == ([] if d == "never" else [f"{d}{i}", "Two words"], calls)
    assert len(json.loads((tmp_path / "asked" / "part.1").read_text())) == 2 and len(json.loads((tmp_path / "asked" / "late.1").read_text())) == 2
    assert enrich.asked_keywords(df.limit(0), "doc_id", str(tmp_path / "none"), ask).count() == 0
