"""Library operators, text repairs and jobs, on rows with nulls, ties and repeats."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarn.functions import python_tier as P
from tarn.functions import registered
from tarn.functions import text as X
from tarn.functions.chunk_rules import type_of
from tarn.operators import fusion, library
from tarn.plans import api, enrich, ingest, retrieve, workflow
from tarn.providers import Offline
from tarn.streaming import jobs, windows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "want,text",
    [
        ("transcript", "Ana:\nHello there\nBen:\nHi"),
        ("transcript", "Ana Lee\n10:32 AM\nhello\nBen Ode\n10:33\nhi"),
        ("content", "Ana Lee\n\n10:32 AM\nhello\nBen Ode\n\n10:33\nhi"),
        ("transcript", "[10:20] Ana:\nhi\n[10:21] Ben:\nho"),
        ("quote", "> to be\n> or not\n— a poet"),
        ("contact", "Reach us\nEmail: a@b.org"),
        ("address", "12 Long Street\nSpringfield"),
        ("appendix", "Appendix A\nSome words follow here."),
        ("glossary", "# Glossary\nKeel: the spine\nRib: a side"),
        ("structured_list", "1. one\n2. two"),
        ("list", "- a\n- [x] b"),
        ("code", "def f():\nreturn 1\nx = 2"),
        ("json", '{"a": 1}'),
        ("json", '```json\n{"a": 1}\n```'),
        ("code", "```sh\nls\n```"),
        ("table", "| a | b |\n|---|---|\n| c | d |"),
        ("heading_only", "# A\n## B"),
        ("faq", "Q: why?\nA: so."),
        ("content", None),
    ],
)
def test_rules(want, text):
    assert type_of(text) == want


def test_text_repairs(spark):
    assert one(spark, X.invented_numbers(F.lit("1,000 boats in 1999"), F.lit("1000 boats"))) == ["1999"]
    text = "a" * 150 + " Keel\nof oak " + "b" * 150
    assert one(spark, X.entity_context(F.lit(text), F.lit("keel"))) == (text[51:151] + "Keel" + text[155:255]).replace("\n", " ").strip()
    assert one(spark, X.entity_context(F.lit("x\ny" * 100), F.lit("zz"))) == ("x\ny" * 100)[:200].replace("\n", " ").strip()
    assert one(spark, X.entity_context(F.lit("Keel first"), F.lit("keel"), 3)) == "Keel fi"
    assert one(spark, X.repaired_summary(F.lit("- One fact.\n2) Another is cut"))) == "One fact."
    assert one(spark, X.repaired_summary(F.lit("no stop"))) == "no stop." and one(spark, X.repaired_summary(F.lit(" "))) == ""
    assert one(spark, X.valid_summary(F.lit("too few words"))) == "" and one(spark, X.valid_summary(F.lit("a  b c d e"))) == "a b c d e"
    assert one(spark, X.valid_summary(F.lit("- a b c d e f"), no_lists=True)) == "" and one(spark, X.valid_summary(F.lit("a b c d e f"), whole_sentence=True)) == ""
    assert one(spark, X.allowed_terms(F.lit("- KEEL\n2. mast\nkeel\nnone"), F.array(F.lit("Keel"), F.lit("Mast")))) == ["Keel", "Mast"]
    assert one(spark, enrich.selected_terms(F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("string"), 1)) == ["a"]
    assert one(spark, X.headings_separated(F.lit("# Boats:\nPart list\nA full sentence here.\na|b"))) == "# Boats.\nPart list.\nA full sentence here.\na|b"
    got = one(spark, X.heading_prefix(F.lit("# A\n\n## B\ntext\n# C")))
    assert (got["headings"], got["body"]) == ("# A\n\n## B", "text\n# C")
    assert tuple(one(spark, X.heading_prefix(F.lit("plain")))) == ("", "plain") and tuple(one(spark, X.heading_prefix(F.lit("# A")))) == ("# A", "")
    month = one(spark, X.month_or_day(F.to_date(F.lit("2024-03-15")), F.lit("in March 2024"), F.lit("Europe/Berlin")))
    assert (month["start"], month["end"]) == (dt.datetime(2024, 2, 29, 23), dt.datetime(2024, 3, 31, 22))
    day = one(spark, X.month_or_day(F.to_date(F.lit("2024-03-15")), F.lit("March 15, 2024"), F.lit("Europe/Berlin")))
    assert (day["start"], day["end"]) == (dt.datetime(2024, 3, 15), dt.datetime(2024, 3, 16))
    table = "| part | wood |\n|--|--|\n| keel | oak |"
    assert one(spark, enrich.table_terms(F.lit(table), F.array(F.lit("Part"), F.lit("oak")), F.lit("table"))) == ["oak"]
    assert one(spark, enrich.table_mentions(F.lit(table), F.array(F.lit("part shop"), F.lit("Oak"), F.lit("pine")), F.lit("table"))) == ["Oak", "pine"]


def test_python_helpers():
    doc = {"type": "doc", "content": [{"type": "text", "text": "lead"}, {"type": "paragraph", "content": [{"type": "text", "text": "a"}]}, {"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableCell", "content": [{"type": "text", "text": "x"}]}, {"type": "tableHeader", "content": [{"type": "text", "text": "y"}]}]}]}]}
    assert P._tree_text(json.dumps(doc)) == "lead\na\nx\ny" and P._tree_text("[1]") == ""
    assert P._blocks("```json\n{")[0]["kind"] == "code" and P._blocks("```json\n{}\n```")[0]["kind"] == "json"
    assert P._keyword_rows('{"chunk_id": 1, "keywords": ["Sail", "sail", "Oar", "Mast"]} {"chunk_id": 2, "keywords": ["x"]}', frozenset("1"), 2) == [{"chunk_id": "1", "keywords": ["Sail", "Oar"]}]
    assert P._table_lines("before\n| a | b |\n|--|--|\n| 1 | 2 | 3 |\n| | |\nafter") == "before\na b\na 1 b 2\nafter"
    assert P._tool_payload('{"structuredContent": {"items": [1]}}') == "[1]"
    assert P._tool_payload('{"content": [{"type": "text", "text": "{\\"k\\": 1}"}, {"type": "text", "text": "t"}]}') == '[{"k": 1}, "t"]'
    assert P._tool_payload("text") == '"text"' and P._tool_payload('{"a": 1}') == '{"a": 1}' and P._tool_payload(None) is None
    assert [round(P._actionability(x), 2) for x in ('{"id": 1, "ok": true, "rows": [1], "name": "n"}', "[1]", '"t"', None)] == [1.0, 0.6, 0.3, 0.1]
    parts = P._prose_parts(10, 6, 100)(" ".join(f"Sentence number {i} has six words." for i in range(12)) + " End.")
    assert len(parts) == 3 and " ".join(parts).count("Sentence") == 12 and parts[-1].endswith("End.")
    merge = P.merge_sections(50)
    chunk = lambda t, k, p="S": {"chunk_index": 0, "part": 0, "text": t, "path": p, "chunk_type": k}
    assert [c["chunk_type"] for c in merge([chunk("- a\n- b", "list"), chunk("1. x\n2. y", "structured_list"), chunk("> q", "quote", "T")])] == ["structured_list", "quote"]


def test_refined_chunks(spark):
    long = " ".join(f"The boat number {i} went to sea." for i in range(40))
    docs = spark.createDataFrame([("a", f"# Log\n\n{long}\n\n## Lists\n\n- a\n- b\n\ntext between\n\n- c\n- d"), ("b", None)], "doc_id string, text string")
    rows = ingest.refined_chunks(ingest.typed_chunks(docs), most=320).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["total"] for r in rows} == {len(rows)}
    logs = [r for r in rows if r["path"] == "Log"]
    assert len(logs) >= 3 and logs[0]["text"].startswith("# Log\n\nThe boat number 0") and " ".join(r["text"] for r in logs).count("boat") == 40


def test_reads_and_writes(spark):
    notes = spark.createDataFrame([(1, 1, "Boat list", None, True, 5), (2, 1, "x", "about a BOAT", False, 9), (3, 2, "boat", "", False, 9), (4, None, None, None, True, 1)], "id int, folder_id int, title string, body string, is_pinned boolean, updated int")
    look = lambda folder, needle: [r["id"] for r in library.visible(notes, folder, needle, ["title", "body"], "is_pinned", "updated", "id").collect()]
    assert look(None, "boat") == [1, 2, 3] and look(F.col("folder_id") == 1, None) == [1, 2] and look(None, "") == [1, 4, 2, 3]
    folders = spark.createDataFrame([(1, "F")], "folder_id int, folder string")
    assert library.with_folder(notes, folders, "folder_id", ["folder"]).count() == 2
    assert [r["id"] for r in library.tagged(notes, spark.createDataFrame([(2, "t"), (2, "t"), (9, "t")], "id int, tag string"), "id").collect()] == [2]
    points = spark.createDataFrame([("a", "0", [1.0, 2.0]), ("a", "1", None)], "doc_id string, chunk_id string, embedding array<double>")
    assert library.scroll(points, ["doc_id", "chunk_id"], 1).columns == ["doc_id", "chunk_id"]
    assert library.dimension_checked(points, 2).count() == 2
    with pytest.raises(Exception, match="not 3"):
        library.dimension_checked(points, 3).collect()
    scored = library.with_seed_scores(points, spark.createDataFrame([("a", "0", 0.5), ("a", "0", 0.7)], "doc_id string, chunk_id string, score double"), ["doc_id", "chunk_id"])
    assert sorted((r["chunk_id"], r["score"], r["is_seed"]) for r in scored.collect()) == [("0", 0.7, True), ("1", None, False)]
    tables = {"documents": spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, version int"), "dates": spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, d string")}
    after = library.replaced_artifacts(tables, spark.createDataFrame([("a", 2)], "doc_id string, version int"), {"dates": tables["dates"].limit(0)})
    assert sorted(map(tuple, after["documents"].collect())) == [("a", 2), ("b", 1)] and [tuple(r) for r in after["dates"].collect()] == [("b", "y")]
    messages = spark.createDataFrame([(1, "pending", None), (2, "complete", "kept")], "id int, status string, text string")
    done = library.finalised(messages, spark.createDataFrame([(1, "complete", "t"), (2, "error", "late"), (3, "complete", "new")], "id int, status string, text string"))
    assert sorted(map(tuple, done.collect())) == [(1, "complete", "t"), (2, "complete", "kept"), (3, "complete", "new")]
    assert library.old_format_ids(spark.createDataFrame([("x" * 74,), ("x" * 73,)], "doc_id string")).count() == 1
    calls = spark.createDataFrame([("kw", 0), ("kw", 1), ("ent", 0)], "kind string, retry int")
    assert sorted(map(tuple, library.call_totals(calls, "kind", F.col("retry") > 0).collect())) == [("ent", 1, 0), ("kw", 1, 1)]
    assert one(spark, library.trimmed(F.lit("- aaaa\n- bbbb\n- cccc"), F.lit(16))) == "- aaaa\n- bbbb\n- [truncated] more was left out"
    steps = F.array(F.struct(F.lit("t").alias("title"), F.lit("do").alias("action")))
    assert one(spark, library.formatted_plan(F.lit("g"), steps, F.lit(0))) == "Goal: g\n>> Step 1: t — do"


def test_retrieval_of_all_sources(spark):
    provider = Offline(dim=32)
    docs = spark.createDataFrame([("a", "The keel of the old boat is made of oak, they say, and it was laid in the spring by two men."), ("b", "The lighthouse lamp turns all night over the rocks, and the keeper sleeps all day in his bed."), ("c", "Bread recipe with rye and salt, to be baked slowly in a hot oven until the crust is dark.")], "doc_id string, text string")
    index = ingest.index_chunks(docs, provider=provider).withColumn("embedding", provider.embed(F.col("embed_text"))).cache()
    q = "lighthouse lamp night"
    vector = one(spark, provider.embed(F.lit(q)))
    notes = docs.select("doc_id", provider.summarise(F.col("text")).alias("content")).withColumn("embedding", provider.embed(F.col("content")))
    got = retrieve.retrieve(index, q, vector, provider=provider, summaries=notes, questions=notes, hyde_vector=vector)
    first = got.hits.first()
    assert first["key"]["doc_id"] == "b" and {"dense", "sparse", "hyde", "filtered_dense", "filtered_sparse"} <= set(first["contributions"]) and not got.errors
    assert got.summaries.count() >= 1
    dated = retrieve.retrieve(index, q, vector, provider=provider, identities=spark.createDataFrame([("a", "*")], "doc_id string, chunk_id string"))
    assert {r["key"]["doc_id"] for r in dated.hits.collect()} == {"a"}
    assert retrieve.retrieve(index, q, vector, provider=provider, identities=spark.createDataFrame([], "doc_id string, chunk_id string")).context.count() == 0
    assert retrieve.expanded(spark, "boats of 1999", "in 1999") == "in 1999" and retrieve.expanded(spark, "boats", "in 1999") is None
    found, errors = fusion.multi_source({"good": lambda: spark.createDataFrame([("k", 1.0)], "key string, score double"), "bad": lambda: spark.range(1).select(F.lit("k").alias("key"), F.raise_error(F.lit("down")).cast("double").alias("score"))}, ["key"])
    assert [r["source"] for r in found.collect()] == ["good"] and "down" in errors["bad"]


def test_endpoints_and_turns(spark):
    documents = spark.createDataFrame([("a", 3, "old"), ("b", 1, "stay")], "doc_id string, version int, text string")
    requests = spark.createDataFrame([("a", 2, "upsert", "late"), ("b", 2, "delete", None), ("c", 1, "upsert", "new")], "doc_id string, version int, action string, text string")
    after, status = api.Notes({"documents": documents}).ingest(requests)
    assert sorted(map(tuple, after.tables["documents"].collect())) == [("a", 3, "old"), ("c", 1, "new")]
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {"a": "stale", "b": "deleted", "c": "indexed"}
    artifacts = spark.createDataFrame([("r", i, f"oak keel part {i}", "keel of oak", 10.0 * i, '{"id": 1}', "search") for i in range(12)] + [("s", 0, None, "q", 0.0, None, None)], "run_id string, place int, summary string, query string, age double, result string, tool string")
    tools = spark.createDataFrame([("find", "s1", "find a keel"), ("find", "s2", "find bread"), ("drop", "s1", "keel keel")], "name string, server string, text string")
    got = workflow.turn(artifacts, tools, "keel", deny=["drop"])
    assert got.artifacts.where("run_id = 'r'").count() == 8 and [r["qualified"] for r in got.tools.collect()][0] == "s1:find"
    assert "[search]" in {r["run_id"]: r["text"] for r in got.context.collect()}["r"]
    assert [r["name"] for r in workflow.turn(artifacts, tools, "keel", remote=spark.createDataFrame([("drop", 1.0)], "name string, score double")).tools.collect()] == ["drop"]


def test_jobs(spark, tmp_path):
    tried, waits = [], []

    def flaky(x):
        tried.append(x)
        if len(tried) < 3:
            raise ConnectionError
        return x

    assert jobs.Retry(5, 1.0)(flaky, 7, sleep=waits.append) == 7 and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        jobs.Retry(3)(lambda: int("x"), sleep=waits.append)
    notes = spark.createDataFrame([(1, 2, "t"), (2, 1, "t")], "id int, version int, text string")
    documents = spark.createDataFrame([(1, 1), (3, 1)], "id int, indexed_version int")
    seen = []
    query = jobs.reconcile_every(spark, f"file://{tmp_path}/ck", 1, lambda: notes, lambda: documents, ["id"], "text", lambda stale, lost: seen.append((sorted(r["id"] for r in stale.collect()), [r["id"] for r in lost.collect()])))
    query.processAllAvailable()
    query.stop()
    assert seen and seen[0] == ([1, 2], [3])
    registered.register(spark)
    rows = spark.sql("SELECT c.place, c.chunk_type, c.text FROM VALUES ('One two three. Four five. Six.') AS d(t), LATERAL text_chunks(d.t, 3) c ORDER BY 1").collect()
    assert [r["text"] for r in rows] == ["One two three.", "Four five. Six."]
    assert spark.sql("SELECT chunk_type('- a\n- b') AS t").first()["t"] == "list"


def test_closed_windows(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:09:00', 'a'").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(source)
    windows.run_to_table(windows.closed_counts(stream, "ts", "1 minute", ["k"], "1 minute"), f"{tmp_path}/out", f"{tmp_path}/ck", "append")
    assert [(r["window_start"].minute, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(0, 1)]


def test_filters_and_terms(spark):
    from tarn.operators import relational, terms

    notes = spark.createDataFrame([("a", '{"lang": "en", "pin": true}', "w " * 300, "secret"), ("b", '{"lang": "de"}', None, None), ("c", None, "short", "")], "doc_id string, meta string, body string, hash string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(relational.among(notes, "doc_id", [])) == ids(relational.among(notes, "doc_id", None)) == ["a", "b", "c"] and ids(relational.among(notes, "doc_id", ["b", "z"])) == ["b"]
    assert ids(notes.where(relational.metadata_is(F.col("meta"), {"lang": "en", "pin": True}))) == ["a"] and ids(notes.where(relational.metadata_is(F.col("meta"), {}))) == ["a", "b", "c"]
    shown = {r["doc_id"]: r for r in relational.public_fields(notes, ["hash"], ["body"]).collect()}
    assert "hash" not in shown["a"].asDict() and shown["a"]["body_truncated"] and len(shown["a"]["body"]) <= 240 and shown["b"]["body"] == "" and not shown["c"]["body_truncated"]
    rows = [("d", s, p, t) for p, (s, t) in enumerate([(1, "Oak keel"), (1, "keel"), (2, "keel"), (2, "oak keel"), (2, "old boat"), (3, "sail")])]
    got = terms.best_terms(spark.createDataFrame(rows, "doc string, section int, place int, term string"), "doc", "section", "place").first()["terms"]
    assert got == ["Oak keel", "old boat"]


def test_push_payloads(spark):
    from tarn.sources import logs

    entries = spark.range(1, 506, numPartitions=2).select((F.col("id") * 1000).alias("nanos"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("body"), F.when(F.col("id") % 2 == 0, "agent").otherwise("backend").alias("service"))
    rows = logs.push_payloads(entries, ["service"], 100).collect()
    assert sum(r["entries"] for r in rows) == 505 and max(r["entries"] for r in rows) <= 100
    stream = json.loads(rows[0]["payload"])["streams"][0]
    assert set(stream["stream"]) == {"service"} and len(stream["values"]) == rows[0]["entries"] and stream["values"][0][1].startswith("line ")
