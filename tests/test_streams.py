"""Change streams with deletes in any order, and streams of answers."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarn.streaming import answers, changes

CHANGES = "id int, version int, action string, text string, at timestamp"
T0 = datetime.datetime(2024, 5, 1, 12)


def day(n):
    return T0 + datetime.timedelta(days=n)


def run(spark, folder, batches, **options):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, CHANGES).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(CHANGES).parquet(str(folder / "in"))
        changes.run_changes(stream, str(folder / "out"), str(folder / "ck"), "id", "version", buckets=4, at="at", **options)
        del i
    rows = changes.snapshot(spark, str(folder / "out"), 99)
    return sorted(tuple(r) for r in rows.select("id", "version", "text").collect())


BATCHES = (
    [(1, 1, "upsert", "a", day(0)), (2, 5, "delete", None, day(0)), (3, 1, "upsert", "x", day(0))],
    [(1, 3, "delete", None, day(1)), (2, 4, "upsert", "old", day(1)), (3, 1, "upsert", "x", day(1))],
    [(1, 2, "upsert", "b", day(2)), (2, 6, "upsert", "new", day(2)), (4, 1, "delete", None, day(2))],
)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_all_orders_of_batches_give_one_table(spark, tmp_path, order):
    assert run(spark, tmp_path, [BATCHES[i] for i in order]) == [(2, 6, "new"), (3, 1, "x")]


def test_tombstones_go_after_their_time(spark, tmp_path):
    batches = [[(1, 2, "delete", None, day(0))], [(1, 1, "upsert", "early", day(5))], [(1, 0, "upsert", "again", day(8)), (5, 1, "upsert", "y", day(8))], [(1, 1, "upsert", "late", day(9))]]
    assert run(spark, tmp_path, batches[:2]) == []
    assert run(spark, tmp_path, batches[2:3], keep="7 days") == [(5, 1, "y")]  # held back once more, and the tombstone goes
    assert run(spark, tmp_path, batches[3:]) == [(1, 1, "late"), (5, 1, "y")]


def test_tables_from_before_tombstones_are_read(spark, tmp_path):
    out = tmp_path / "out"
    spark.createDataFrame([(1, 1, "a", day(0))], "id int, version int, text string, at timestamp").withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")).write.partitionBy("_bucket").parquet(str(out / "v0"))
    bucket = [p.name for p in (out / "v0").iterdir() if p.name.startswith("_bucket=")][0].removeprefix("_bucket=")
    spark.createDataFrame([(int(bucket), 0)], "bucket int, version int").coalesce(1).write.parquet(str(out / "_list" / "v0"))
    assert changes.snapshot(spark, str(out), 0).count() == 1
    got = run(spark, tmp_path, [[(9, 1, "upsert", "z", day(0))], [(1, 2, "delete", None, day(1))]])
    assert got == [(9, 1, "z")]


# -- answers -----------------------------------------------------------------------------------------------------


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def message(name, r, start):
    """The items of a message that ends, fails or breaks off."""
    kind, t = r.choice(["end", "error", "cut", "cut", "end"]), start
    items = [(name, 0, "start", None, r.choice([None, 7]), None, None, at(t))]
    for i in range(r.randint(0, 6)):
        t += r.random() * 2
        items.append((name, i + 1, "delta", r.choice(["so ", "it is ", "", None, "word"]), None, None, None, at(t)))
    if r.random() < 0.6:
        items.append((name, len(items), "usage", None, r.choice([None, 9]), r.choice([None, 0, 4]), r.choice([None, 13]), at(t)))
    if kind != "cut":
        items.append((name, len(items), kind, r.choice(["broken", None]) if kind == "error" else None, None, None, None, at(t + 0.5)))
        if r.random() < 0.3:
            items.append((name, len(items), "delta", "too late", None, None, None, at(t + 0.6)))
    elif r.random() < 0.4 and len(items) > 2:
        items.append((name, len(items) + 2, "end", None, None, None, None, at(t + 0.5)))  # two items never come
    return items


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, answers.ROCKSDB)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def streamed(spark, folder, batches):
    (folder / "in").mkdir()
    stream = answers.answer_stream(spark.readStream.schema(answers.ITEM).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), 30)
    for b in batches:
        spark.createDataFrame(b, answers.ITEM).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema(answers.ANSWER).parquet(str(folder / "out")).collect() if not r["message_id"].startswith("clock")), key=str)


def clock(seconds):
    return [(f"clock{seconds}", 0, "start", None, None, None, None, at(seconds))]


def test_the_stream_equals_the_table(spark, tmp_path, rocksdb):
    r = random.Random(5)
    every = [message(f"m{i:02}", r, r.random() * 5) for i in range(40)]
    items = [x for m in every for x in m]
    want = sorted((tuple(x) for x in answers.answers(spark.createDataFrame(items, answers.ITEM)).collect()), key=str)
    assert {x[2] for x in want} == {"complete", "failed", "partial"}
    r.shuffle(items)
    items += r.sample(items, 20)  # some come twice
    third = len(items) // 3
    got = streamed(spark, tmp_path, [items[:third], items[third : 2 * third], items[2 * third :], clock(200), clock(201)])
    assert got == want


def test_a_silent_message_is_partial_and_stays_closed(spark, tmp_path, rocksdb):
    begun = [("a", 0, "start", None, 3, None, None, at(0)), ("a", 1, "delta", "half an", None, None, None, at(1.5))]
    rest = [("a", 2, "delta", " answer", None, None, None, at(31)), ("a", 3, "end", None, None, None, None, at(31))]
    got = streamed(spark, tmp_path, [begun, clock(62), clock(63), rest, clock(200), clock(201)])
    assert got == [("a", "half an", "partial", None, 1, 1500, 1500, 3, 2, 5)]


def test_answers_of_odd_tables(spark):
    df = spark.createDataFrame([], answers.ITEM)
    assert answers.answers(df).count() == 0
    rows = [("e", 0, "end", None, None, None, None, at(0)), ("x", 0, "error", None, None, None, None, at(0)), (None, 0, "delta", "t", None, None, None, at(0)), ("u", 0, "usage", None, 1, 2, 3, at(0)), ("u", 0, "usage", None, 1, 2, 3, at(0))]
    got = {r["message_id"]: r for r in answers.answers(spark.createDataFrame(rows, answers.ITEM)).collect()}
    assert (got["e"]["status"], got["e"]["text"], got["e"]["first_token_ms"]) == ("complete", "", None)
    assert (got["x"]["status"], got["x"]["error"]) == ("failed", "unknown error")
    assert (got[None]["status"], got[None]["completion_tokens"]) == ("partial", 1) and tuple(got["u"])[-3:] == (1, 2, 3)
