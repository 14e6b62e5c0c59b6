"""The registered queries against their SQL on the smallest tables, and the pipeline's stages against what they promise."""

import random
import re

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tools.compare import canonical

import corpus_pipeline
from tarn.llm import mixing, toxicity
from tarn.llm import queries as q
from tarn.session import TABLES
from tests.llm.test_text import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, rel = q.QUERIES[name](spark, SF), duck.sql(q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.columns, df.collect()) == canonical(rel.columns, rel.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, known = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, SF), f"test-{name}")
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= known
        if name == "exact_dedup":
            assert docs.count() == docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count() == before.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).distinct().count()
        if name == "ngram_jaccard":
            again = q.link_components(docs).where("doc_id <> component_id")
            assert again.isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def fixture(spark, folder):
    r = random.Random(4)
    plain = [f"{a}{b}" for a in "river stone cloud lamp paper green window table song bread".split() for b in ("", "s", "ing", "ed")]
    docs, labels = [], []
    for i in range(260):
        words = [r.choice(plain) for _ in range(r.randint(12, 60))]
        if i % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["rotten", "vermin"]))
        if i % 3 == 0:
            words += ["coupon", "lottery"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 > 0), int(i % 4 == 0)))
        if i % 5 == 1:
            docs.append((1000 + i, "  ".join(words)))
        if i % 5 == 2:
            docs.append((2000 + i, " ".join([*words, "bread"])))
    docs += [(None, "lone null id of five words"), (None, docs[3][1] + " song"), (7, "the same id but a text of its own"), (5, docs[5][1]), (9001, None), (9002, ""), (None, None), (9003, "few words"), (9004, "word " * 30_000)]
    rows = [(*d, "x", 1) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, copy string, row int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_all_rows_equal_a_plain_pipeline(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = fixture(spark, folder)
    last = lambda d: (d[0] is None, d[0] or 0)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")

    score = toxicity.fit(frame(docs), labels).scorer()
    kept = [d for d in docs if score(d[1] or "") < 0.5]
    assert 150 < len(kept) < len(docs) - 50

    first = {}
    for d in sorted(kept, key=last):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d[1] or ""), d)
    kept = list(first.values())

    numbered = [(i, t) for i, (_, t) in enumerate(sorted(kept, key=last))]
    leaders = [i for i, n, c in plain_components(numbered) if i == c]
    kept = [sorted(kept, key=last)[i] for i in leaders]
    assert len(kept) < len(first)

    model = mixing.fit_domains(frame(kept), labels, domain=mixing.domain_of(q="quality"))
    step, _, _ = mixing.fit_rates(mixing.written(mixing.memberships(frame(kept), model), "m"), model.domains, corpus_pipeline.QUALITY_WEIGHTS)
    of = model.posteriors()
    shares = {(r["doc_id"], r["text"]): r["share"] for r in frame(kept).select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))), F.lit(1 << 53)) / float(1 << 53)).alias("share")).collect()}
    sp, want = sentencepiece.SentencePieceProcessor(model_file=q.piece_model()), []
    for d in kept:
        rate = max(0.0, 1 - float(of(d[1] or "") @ step[0]))
        want += [(d[0], len(sp.encode(d[1] or "", add_eos=True)))] * (int(rate) + (shares[d] < rate - int(rate)))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=str) == sorted(want, key=str)


def test_near_copies_of_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(None, text), (None, text + " x"), (7, "a text that no other is near to"), (7, text + " y"), (3, text + " z"), (8, "lone of its own kind"), (8, "lone of its own kind"), (9, ""), (9, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    got = corpus_pipeline.ngram_jaccard(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([rows[2], rows[4], rows[5], rows[7], rows[8]], key=str)


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, row int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
