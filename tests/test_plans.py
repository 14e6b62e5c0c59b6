import datetime
import json

from pyspark.sql import functions as F

from tarn.functions import python_tier as P
from tarn.plans import api, ingest, retrieve
from tarn.providers import Offline
from tarn.sources import logs

NOTE = "# Boats\n\nIntro about the fleet of the town.\nSecond line here.\n\nMore words on the same theme.\n\n## Hulls\n\n| part | wood |\n|---|---|\n| keel | oak |\n| rib | ash |\n\n---\n\nAfter the rule comes prose.\n\n```sh\nmake all\n```\n\n# Empty end"


def test_blocks():
    kinds = [b["kind"] for b in P._blocks(NOTE)]
    assert kinds == ["heading", "prose", "prose", "heading", "table", "divider", "prose", "code", "heading"]
    assert P._blocks("```\nnever closed")[0]["kind"] == "code" and P._blocks(None) == []


def test_typed_chunks(spark):
    docs = spark.createDataFrame([("a", NOTE), ("b", "Q: Open?\nA: Yes."), ("c", None), ("d", " ")], "doc_id string, text string")
    rows = ingest.typed_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_type"]) for r in rows] == [("a", "content"), ("a", "table"), ("a", "content"), ("a", "code"), ("a", "heading_only"), ("b", "faq")]
    assert rows[0]["text"].startswith("# Boats") and "same theme" in rows[0]["text"]
    assert [r["path"] for r in rows][:2] == ["Boats", "Boats > Hulls"] and rows[4]["path"] == "Empty end"


def test_index_and_retrieve(spark):
    docs = spark.createDataFrame([("a", NOTE), ("b", "The lighthouse lamp turns all night over the rocks."), ("c", "Bread recipe with rye and salt.")], "doc_id string, text string")
    provider = Offline(dim=32)
    index = ingest.index_chunks(docs, provider=provider).withColumn("embedding", provider.embed(F.col("embed_text"))).cache()
    by = {(r["doc_id"], r["chunk_index"]): r for r in index.collect()}
    assert by["a", 1]["skip_reason"] == "" and by["a", 1]["embed_text"].startswith("Table from section: Boats > Hulls. Columns: part, wood.")
    assert by["a", 3]["skip_reason"] == "structural:code" and by["a", 0]["next_id"] == "1" and by["a", 0]["prev_id"] is None
    q = "lighthouse lamp night"
    vector = spark.range(1).select(provider.embed(F.lit(q)).alias("v")).first()["v"]
    got = retrieve.retrieve(index, q, vector, provider=provider)
    assert got.context.first()["doc_id"] == "b" and not got.errors and got.references.count() >= 1
    assert retrieve.retrieve(index, q, vector, docs.limit(0), provider=provider).context.count() == 0


def test_python_tier(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}, {"type": "heading", "content": [{"type": "text", "text": "c"}]}]}
    assert one(P.tree_text(F.lit(json.dumps(tree)))) == "a\nb\nc" and one(P.tree_text(F.lit("oops"))) == ""
    reply = 'Sure: {"chunk_id": "1", "keywords": ["sail", " "]} and {"results": [{"chunk_id": 2, "keywords": ["oar"]}]} {broken'
    assert [(r["chunk_id"], r["keywords"]) for r in one(P.keyword_rows(F.lit(reply)))] == [("1", ["sail"]), ("2", ["oar"])]
    assert one(P.nfkc(F.lit(" ﬁn "))) == "fin"
    assert json.loads(one(P.truncated_result(2, 10)(F.lit('[1,2,3]')))) == {"result": [1, 2], "truncated": True}
    assert one(P.sections(F.lit("# Plan\n- one\n2. two\nrest")))[0]["items"] == ["one", "two"]
    parts = one(P.windows(6)(F.lit("|part|w|\n|--|--|\n" + "\n".join(f"|k {i}|oak x|" for i in range(6)))))
    assert len(parts) > 1 and all(p.startswith("|part|w|\n|--|--|\n") for p in parts)
    assert one(P.windows(3)(F.lit("One two three. Four five. Six."))) == ["One two three.", "Four five. Six."]


def test_logs(spark, tmp_path):
    line = json.dumps({"log": json.dumps({"level": "info", "event": "request"}), "stream": "stdout", "time": "2024-05-01T10:00:00.000001Z"})
    r = logs.parsed(spark.createDataFrame([(line, "x.backend.1"), ("garbage", "q")], "value string, tag string"), tag="tag").collect()
    assert (r[0]["level"], r[0]["event"], r[0]["service"], r[0]["nanos"]) == ("info", "request", "backend", 1714557600000001000)
    assert r[1]["body"] == "garbage" and r[1]["service"] == "other"
    m = logs.metrics(spark.createDataFrame([('hits{method="GET",path="/a"} 3',), ("# HELP x",), ("up 1",)], "value string")).collect()
    assert [(x["name"], x["value"]) for x in m] == [("hits", 3.0), ("up", 1.0)] and m[0]["labels"] == {"method": "GET", "path": "/a"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.agent.log").write_text(line + "\n")
    logs.push(logs.parsed(logs.tail(spark, str(tmp_path / "in")), tag="tag"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["service"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["agent"]


def test_api(spark):
    at = datetime.datetime(2024, 1, 1)
    notes = spark.createDataFrame([("n1", "u", "f", "Red kite", "the kites", False, at), ("n2", "u", "f", "Other", "nothing", True, at), ("n3", "v", "g", "Red", "x", False, at)], "id string, user_id string, folder_id string, title string, content_text string, is_pinned boolean, updated_at timestamp")
    folders = spark.createDataFrame([("f", "u", "F", False, at), ("g", "v", "G", False, at)], "id string, user_id string, name string, is_pinned boolean, updated_at timestamp")
    tags = spark.createDataFrame([("t1", "u", "z"), ("t2", "u", "a")], "id string, user_id string, name string")
    links = spark.createDataFrame([("n1", "t1"), ("n1", "t2"), ("n2", "t1")], "note_id string, tag_id string")
    store = api.Notes({"notes": notes, "folders": folders, "tags": tags, "notetags": links})
    got = store.list_notes("u", search="kite").collect()
    assert [(r["id"], r["tags"]) for r in got] == [("n1", ["a", "z"])]
    assert [r["id"] for r in store.list_notes("u").orderBy(F.col("is_pinned").desc()).collect()] == ["n2", "n1"]
    left = store.delete_folder("u", "f")
    assert left.tables["notes"].count() == 1 and left.tables["notetags"].count() == 0
    assert [r["name"] for r in store.list_tags("u").collect()] == ["a", "z"]


def test_enrichment(spark):
    from tarn.plans import enrich

    chunks = spark.createDataFrame(
        [("a", 0, "0", "content", 4, "Tide tables of 2024-02-03 say tide."), ("a", 1, "1", "code", 9, "x = 1"), ("a", 2, "2", "content", 7, "Second part. More of it here today."), ("b", 0, "0", "content", 6, "Short note about rain and rain.")],
        "doc_id string, chunk_index int, chunk_id string, chunk_type string, tokens int, text string",
    )
    got = {(r["doc_id"], r["chunk_index"]): r["batch"] for r in enrich.batches(chunks, "doc_id", 2, 12).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 2, ("b", 0): 0}
    assert [r["keywords"][0] for r in enrich.keywords(chunks).orderBy("doc_id", "chunk_index").collect() if r["keywords"]] == ["tide", "here", "rain"]
    sums = {r["doc_id"]: (r["groups"], r["summary"]) for r in enrich.summaries(chunks, "doc_id", budget=6, least=5).collect()}
    assert sums == {"a": (1, "Second part. More of it here today."), "b": (1, "Short note about rain and rain.")}
    assert enrich.summaries(chunks, "doc_id").count() == 0  # by default chunks of fewer than ten tokens are not summarised
    assert [(r["chunk_id"], r["date_text"]) for r in enrich.chunk_dates(chunks, "doc_id").collect()] == [("0", "2024-02-03")]
    texts = ["", "--- !", "# Head", "two words", "- bullet of some words", "A full line of text."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r["v"] for r in df.select("i", enrich.verdict(F.col("t")).alias("v")).orderBy("i").collect()] == ["discard", "discard", "merge", "merge", "merge", "valid"]
    reason = df.select(enrich.keyword_skip_reason(F.lit("content"), F.lit("12 34"), F.lit("")).alias("x")).first()["x"]
    assert reason == "non_lexical"
