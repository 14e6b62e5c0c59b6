from pyspark.sql import functions as F

from tarn.operators import context, fusion, relational, terms
from tarn.streaming import changes, windows


def test_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([([(0, 5), (1, 9), (2, 4)],), ([],)], "items array<struct<at:int,n:int>>")
    got = [[x["at"] for x in r["k"]] for r in rows.select(context.budget_fill(F.col("items"), 10).alias("k")).collect()]
    assert got == [[0, 2], []]


def test_rrf_counts_a_source_that_repeats(spark):
    hits = spark.createDataFrame([("dense", "a", 1), ("sparse", "a", 2), ("dense", "b", 2)], "source string, id string, rank int")
    got = fusion.rank_fused(hits, ["id"]).collect()
    assert [r["id"] for r in got] == ["a", "b"]
    assert abs(got[0]["rrf"] - (1 / 61 + 0.9 / 62)) < 1e-12


def test_failed_source_is_empty(spark):
    def broken():
        raise ValueError("down")

    hits, errors = fusion.multi_source({"dense": lambda: spark.createDataFrame([("a", 0.5)], "id string, score double"), "sparse": broken}, ["id"])
    assert hits.count() == 1 and "down" in errors["sparse"]


def test_pruned_terms(spark):
    got = spark.createDataFrame([(["sea salt", "salt", "coarse sea salt", "pepper"],)], "t array<string>").select(terms.pruned(F.col("t")).alias("t")).first()["t"]
    assert got == ["coarse sea salt", "pepper"]


def test_clean_terms(spark):
    df = spark.createDataFrame([("the red kite of",), ("thing",), (None,), ("---",)], "raw string")
    got = [r["term"] for r in terms.clean_terms(df, "raw", frozenset({"the", "of"}), frozenset({"thing"})).collect()]
    assert got == ["red kite", None, None, None]


def test_complete_names(spark):
    names = spark.createDataFrame([(1, "ada"), (1, "ada byron"), (1, "ben"), (1, "ben hill"), (1, "ben dale")], "doc int, name string")
    got = {r["name"]: r["full"] for r in terms.complete_names(names, "doc", "name").collect()}
    assert got["ada"] == "ada byron" and got["ben"] is None


def test_no_identities_no_points(spark):
    points = spark.createDataFrame([("d", "0")], "doc_id string, chunk_id string")
    assert relational.by_identity(points, points.limit(0)).count() == 0


def test_neighbours_fall_back_to_skipped(spark):
    chunks = spark.createDataFrame([("d", "1", "one")], "doc_id string, chunk_id string, text string")
    skipped = spark.createDataFrame([("d", "0", "zero")], "doc_id string, chunk_id string, text string")
    seeds = spark.createDataFrame([("d", "0", "1")], "doc_id string, prev_id string, next_id string")
    r = context.with_neighbours(seeds, chunks, skipped).first()
    assert (r["prev_text"], r["next_text"]) == ("zero", "one")


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "upsert", "a"), (1, 3, "upsert", "c"), (2, 1, "upsert", "x"), (1, 2, "upsert", "b"), (2, 2, "delete", None), (3, 1, "delete", None)]
    schema = "id int, version int, action string, text string"
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.run_changes(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "id", "version")
    got = sorted(tuple(r) for r in changes.snapshot(spark, str(tmp_path / "out"), 99).select("id", "version", "text").collect())
    assert got == [(1, 3, "c")]


def test_version_guard(spark, tmp_path):
    schema = "id int, version int"
    spark.createDataFrame([(1, 2), (2, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    guarded = changes.version_guard(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "version")
    for more in (None, [(1, 1), (2, 5)]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows.run_to_table(guarded, str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, False), (1, 2, True), (2, 1, True), (2, 5, True)]


def test_assist(spark):
    from tarn.operators import assist

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    raw = F.lit('{"a": {"b": [1, 2]}, "n": 3, "s": "t", "ok": true}')
    assert one(assist.json_lookup(raw, "a.b.1")) == "2" and one(assist.json_lookup(raw, "a.__class__")) is None
    assert one(assist.json_lookup(raw, "a.b.c.d.e.f.g.h.i")) is None
    assert [one(assist.json_kind(F.lit(x))) for x in ('{"a":1}', "[1]", '"s"', "2.5", "true", "null", "{")] == ["object", "array", "string", "number", "boolean", "null", "invalid"]
    assert one(assist.argument_errors(raw, {"n": "string", "s": "string", "q": "number"}, ["q"])) == ["n should be string, not number", "q is missing"]
    assert [r["text"] for r in one(assist.dates_in(F.lit("on 2024-05-01, 2024-13-01 and 2024-05-01")))] == ["2024-05-01"]
    assert one(assist.grounded(F.lit("It is so."), F.array(F.lit("note 4")))) == "It is so.\n\nSources: note 4"
    assert one(assist.usage_delta(F.create_map(F.lit("in"), F.lit(3)), F.create_map(F.lit("in"), F.lit(5), F.lit("out"), F.lit(2)))) == {"in": 2, "out": 2}
    assert one(assist.is_simple_query(F.lit("when is the regatta?"))) and not one(assist.is_simple_query(F.lit("compare the two hulls")))
    assert assist.rendered("Hi {name}", name="Ada") == "Hi Ada"


def test_terms_of_documents_are_shuffled_once(spark):
    """What is dealt are the texts: counts, sections and places of a document's terms need no other shuffle."""
    from tarn.queries import term_rank

    plan = term_rank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
