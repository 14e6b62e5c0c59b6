"""Chunks of a document are made once, in bounded batches, without a shuffle, and whatever the ids are."""

import uuid

import pytest
from pyspark.sql import functions as F

from tarn.functions import tokens
from tarn.functions.text import uuid5
from tarn.functions.typed_split import typed_split
from tarn.plans import ingest
from tarn.providers import Offline

LONG = " ".join(f"The boat number {i} went to sea." for i in range(40))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_chunks_split_each_text_once_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.createDataFrame([(1, "# A\n\ntext"), (2, None)], "doc_id long, text string")
    assert plan(ingest.typed_chunks(docs)).count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_refined_documents_are_one_pass_and_keep_null_ids_apart(spark):
    texts = [f"# Log\n\n{LONG}\n\n## Lists\n\n- a\n- b\n\nbetween\n\n- c", "# Other\n\n- x\n- y\n\n## Second\n\nwords"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (3, None)], "doc_id long, text string")
    out = ingest.refined_documents(docs, most=320)
    assert plan(out).count("ArrowEvalPython") == 1 and "Exchange" not in plan(out)
    alone = [sorted((r["chunk_index"], r["total"], r["chunk_type"], r["text"], r["path"]) for r in ingest.refined_chunks(ingest.typed_chunks(spark.createDataFrame([(1, t)], "doc_id long, text string")), most=320).collect()) for t in texts]
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(tuple(x) for a in alone for x in a)


def test_short_texts_that_come_again_are_split_once():
    calls = []

    def split(t):
        calls.append(t)
        return typed_split(t)

    run = ingest.each(split)
    long = "x " * ingest.SHORT_TEXT
    assert [[c.text for c in x] for x in run(["a", "# b\n\nc", "a", long, long])] == [[c.text for c in typed_split(t)] for t in ("a", "# b\n\nc", "a", long, long)]
    assert calls == ["a", "# b\n\nc", long, long]


def test_index_chunks_link_within_a_document_without_a_shuffle(spark):
    pairs = tokens.BytePairs({bytes([i]): i for i in range(256)} | {b"bo": 256, b"at": 257, b"boat": 258})
    docs = spark.createDataFrame([(1, f"# A\n\n{LONG}"), (1, f"# B\n\n{LONG}"), (2, "- a\n- b")], "doc_id long, text string")
    out = ingest.index_chunks(docs, provider=Offline(tokenizer=pairs))
    assert plan(out).count("ArrowEvalPython") == 2 and "Exchange" not in plan(out)  # the split, and lines of tables
    rows = out.collect()
    for r in rows:
        at = r["chunk_index"]
        assert r["prev_id"] == (str(at - 1) if at else None) and r["next_id"] == (str(at + 1) if at + 1 < r["total"] else None)
        assert r["tokens"] == pairs.count(r["text"]) and r["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['doc_id']}-{at}"))
    assert sum(r["prev_id"] is None for r in rows) == 3


@pytest.mark.parametrize("word", [b"boatboat", b"xbobo", b"aaaaaaaa", b"\xc3\xa4boat", b"b"])
def test_short_and_long_words_end_alike(word):
    pairs = tokens.BytePairs({bytes([i]): i for i in range(256)} | {b"aa": 256, b"bo": 257, b"at": 258, b"boat": 259, b"aaaa": 260})
    assert pairs.ends(word) == pairs._ends_of_long(word)


def test_uuid5_of_null(spark):
    assert spark.range(1).select(uuid5(F.lit(None).cast("string")).alias("u")).first()["u"] is None


def test_words_of_one_turn_alone_are_not_kept(spark):
    from tarn.operators import agent

    words = [["a", "b", "c", "u1"], ["a", "b", "c", "u2", "u3"], ["x"], [], ["a", "b", "c", "u4", "u5"], ["c", "b", "v1", "v2", "v3", "v4"]]
    turns = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)] + [(2, 0, ["a"]), (2, 1, ["a"])], "conv long, turn int, own array<string>")
    out = agent.uniqueness_of(turns, "conv", "turn", "own")
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(1, i): 1.0 if i == 0 else 0.5 if not w else 1 - max(like(w, x) for x in words[:i] if x) for i, w in enumerate(words)} | {(2, 0): 1.0, (2, 1): 0.0}
    assert {(r["conv"], r["turn"]): round(r["uniqueness"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}
    moved = spark.read.parquet(*{f for f in out.inputFiles() if "uniqueness-words" in f})
    assert {r["_word"] for r in moved.select("_word").distinct().collect()} == {"a", "b", "c"}
