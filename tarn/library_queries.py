"""Queries of library reads and writes, text repairs and scoped search over the tables, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import python_tier as P
from tarn.functions import text as X
from tarn.operators import fulltext, fusion, library
from tarn.plans import ingest
from tarn.queries import _COSINE, query, query_vector, shared
from tarn.session import table


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND (contains(lower(coalesce(o_orderpriority, '')), 'high') OR contains(lower(coalesce(o_orderstatus, '')), 'high'))""")
def visible_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("pinned", F.col("o_orderpriority") == "1-URGENT")
    return library.visible(orders, F.col("o_orderstatus") == "O", "HIGH", ["o_orderpriority", "o_orderstatus"], "pinned", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id FROM documents WHERE length(source || '-' || CAST(doc_id AS VARCHAR)) > 8")
def old_format_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"))
    return library.old_format_ids(named, "name", 8).select("doc_id")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def notes_with_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return library.with_folder(table(spark, sf_dir, "customer"), folders, "c_nationkey", ["n_name"]).select("c_custkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def tagged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return library.tagged(table(spark, sf_dir, "orders"), tags, "o_orderkey", F.col("l_returnflag") == "R").select("o_orderkey")


@query("SELECT doc_id, s.score, s.score IS NOT NULL AS is_seed FROM documents LEFT JOIN (SELECT doc_id, max(CAST(quality AS DOUBLE)) AS score FROM labels GROUP BY 1) s USING (doc_id)")
def seed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return library.with_seed_scores(table(spark, sf_dir, "documents").select("doc_id"), seeds, ["doc_id"])


@query("SELECT event_type, count(*) FILTER (WHERE value <= 100) AS calls, count(*) FILTER (WHERE value > 100) AS retries FROM events GROUP BY 1")
def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.call_totals(table(spark, sf_dir, "events"), "event_type", F.col("value") > 100)


@query("""WITH d AS (SELECT CASE WHEN trim(coalesce("text", '')) = '' THEN 'empty_embed_text' WHEN lang = 'de' THEN 'structural:code' WHEN n_chars < 100 THEN 'quality:min_tokens<100' ELSE '' END AS r FROM documents)
SELECT split_part(r, ':', 1) AS class, count(*) AS chunks FROM d WHERE r <> '' GROUP BY 1""")
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "de", "code").otherwise("content")
    reason = ingest.skip_reason(kind, F.col("n_chars"), F.coalesce("text", F.lit("")), F.lit(""), least=100)
    return library.skip_counts(table(spark, sf_dir, "documents").select(reason.alias("skip_reason")))


@query("SELECT conv_id, count(*) AS context_chunks FROM conversations GROUP BY 1")
def context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.collect_list(F.coalesce("turn", F.lit(-1))).alias("chunks"))
    return library.context_chunks(refs, "conv_id")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def scroll_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.scroll(library.dimension_checked(table(spark, sf_dir, "embeddings"), len(query_vector(spark, sf_dir))), ["vec_id"], 100)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.newest_summaries(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 500).select("o_orderkey", "o_orderdate")


@query("SELECT doc_id, source FROM documents JOIN (SELECT doc_id, min(-doc_id) AS place FROM labels GROUP BY 1) USING (doc_id) ORDER BY place, doc_id LIMIT 20")
def summaries_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "labels").select("doc_id", (-F.col("doc_id")).alias("place"))
    return library.summaries_of(table(spark, sf_dir, "documents").select("doc_id", "source"), ranked, "doc_id", "place", 20).select("doc_id", "source")


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS chunk FROM lineitem WHERE l_orderkey % 50 <> 0
UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 0""")
def replaced_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document comes again; every other of these has one chunk, the rest has none."""
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("chunk"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("version"))
    arrivals = documents.where("doc_id % 50 = 0").withColumn("version", F.lit(2))
    new = arrivals.where("doc_id % 100 = 0").select("doc_id", F.lit("new").alias("chunk"))
    return library.replaced_artifacts({"documents": documents, "chunks": chunks}, arrivals, {"chunks": new})["chunks"]


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 AND role = 'assistant' THEN 'complete' WHEN turn % 3 = 0 THEN 'error' ELSE role END AS status FROM conversations WHERE NOT (turn % 3 = 0 AND role = 'user')
UNION ALL SELECT conv_id * 1000 + turn, 'complete' FROM conversations WHERE turn % 3 = 0 AND role = 'user'""")
def finalised_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages are complete, others are in the status of their role; every third message gets a result."""
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    turns = table(spark, sf_dir, "conversations")
    third = F.col("turn") % 3 == 0
    messages = turns.select(key, F.when(third & (F.col("role") == "user"), "complete").otherwise(F.col("role")).alias("status"))
    results = turns.where(third).select(key, F.when(F.col("role") == "assistant", "complete").otherwise("error").alias("status"))
    return library.finalised(messages, results)


@query("""WITH a AS (SELECT doc_id, [upper(lang), source] AS said FROM documents), b AS (SELECT doc_id, list_transform(said, lambda x: lower(x)) AS said FROM a)
SELECT doc_id, concat_ws(',', CASE WHEN list_contains(said, 'en') THEN 'En' END, CASE WHEN list_contains(said, 'de') THEN 'De' END, CASE WHEN list_contains(said, 'src1') THEN 'Src1' END) AS terms FROM b""")
def allowed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("- "), F.upper("lang"), F.lit("\n2. "), F.col("source"), F.lit("\n* "), F.lower("lang"))
    allowed = F.array(F.lit("En"), F.lit("De"), F.lit("Src1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.allowed_terms(reply, allowed), ",").alias("terms"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS start, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS \"end\" FROM orders")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("in "), F.date_format("o_orderdate", "MMMM yyyy"))
    span = X.month_or_day(F.to_date("o_orderdate"), named, F.lit("UTC"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", span.alias("s"))
    return rows.select("o_orderkey", F.col("s.start").cast("timestamp_ntz").alias("start"), F.col("s.end").cast("timestamp_ntz").alias("end"))


@query("SELECT event_id, CASE WHEN CAST(event_id AS VARCHAR) = CAST(user_id AS VARCHAR) THEN 0 ELSE 1 END AS invented FROM events")
def invented_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, asked = F.concat(F.lit("about "), F.format_number("event_id", 0)), F.concat(F.lit("of "), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.size(X.invented_numbers(said, asked)).alias("invented"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.3 END AS actionability FROM events""")
def actionability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, kind = F.coalesce("props", F.lit("{}")), F.col("event_id") % 4
    inner = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit('{"id": 1, "ok": true, "rows": ['), props, F.lit("]}"))).when(kind == 2, F.concat(F.lit("["), props, F.lit("]"))).otherwise(F.lit('"words"'))
    reply = F.concat(F.lit('{"structuredContent": {"result": '), inner, F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", F.round(P.actionability(P.tool_payload(reply)), 6).alias("actionability"))


@query(f"""WITH s AS (SELECT vec_id, label, {_COSINE} AS score FROM embeddings), a AS (SELECT label, arg_min(score, vec_id) AS score FROM s GROUP BY 1),
l AS (SELECT label FROM a ORDER BY round(score, 9) DESC, label LIMIT 3),
d AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM s ORDER BY r LIMIT 50),
f AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM s WHERE label IN (SELECT label FROM l) ORDER BY r LIMIT 50),
u AS (SELECT vec_id, 1.0 / (60 + r) AS part FROM d UNION ALL SELECT vec_id, 0.8 / (60 + r) FROM f)
SELECT vec_id, round(sum(part), 9) AS rrf FROM u GROUP BY 1 ORDER BY rrf DESC, vec_id LIMIT 30""")
def scoped_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by their vectors, and once more within the three labels whose first point (their summary) is nearest."""
    points, vector = table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)
    summaries = points.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    near = fusion.cosine_top_k(summaries, vector, 1 << 20, "label").orderBy(F.round("score", 9).desc(), "label").limit(3)
    narrowed = points.join(F.broadcast(near.select("label")), "label", "left_semi")
    hits, _ = fusion.multi_source({"dense": lambda: fusion.cosine_top_k(points, vector, 50, "vec_id"), "filtered": lambda: fusion.cosine_top_k(narrowed, vector, 50, "vec_id")}, ["vec_id"])
    fused = fusion.rank_fused(hits, ["vec_id"], {"dense": 1.0, "filtered": 0.8}, top=None).select("vec_id", F.round("rrf", 9).alias("rrf"))
    return fused.orderBy(F.col("rrf").desc(), "vec_id").limit(30)


@query()
def refined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ingest.refined_documents(docs).select("doc_id", "chunk_index", "chunk_type", F.sha2("text", 256).alias("text_sha256"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.write_postings(fulltext.postings(table(spark, sf_dir, "documents")), shared(spark, "postings"))


_WORDS = """WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(coalesce("text", '')), '[[:alnum:]]+')) AS ws FROM documents)"""
_LICENSING = "list_has_any(ws, ['license', 'licensed', 'licenses', 'licensing', 'licensings'])"
_GENERAL = "list_has_any(ws, ['general', 'generals', 'generally'])"


@query(f"""{_WORDS} SELECT doc_id, 'the licensing of generals' AS query FROM w WHERE {_LICENSING} AND {_GENERAL}
UNION ALL SELECT doc_id, 'stupidities' FROM w WHERE list_has_any(ws, ['stupid', 'stupids', 'stupidly', 'stupidity', 'stupidities']) UNION ALL SELECT doc_id, 'works' FROM w WHERE list_has_any(ws, ['work', 'works', 'worked', 'working'])""")
def full_text_by_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches over one index; the SQL names the words of each stem."""
    index, out = _index(spark, sf_dir), None
    for q in ("the licensing of generals", "stupidities", "works"):
        found = fulltext.search(index, q).select(F.col("id").alias("doc_id"), F.lit(q).alias("query"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""{_WORDS} SELECT doc_id, source FROM w WHERE source ILIKE '%licensed%' OR {_LICENSING}
UNION ALL SELECT doc_id, source || '!' FROM w WHERE source ILIKE '%rc1%'""")
def title_or_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source contains the needle or whose text has its terms: one needle found in texts, one in sources."""
    docs, index = table(spark, sf_dir, "documents"), _index(spark, sf_dir)
    by_text = fulltext.title_or_text(docs, "licensed", "doc_id", "source", "text", index).select("doc_id", "source")
    by_title = fulltext.title_or_text(docs, "rc1", "doc_id", "source", "text", index).select("doc_id", F.concat("source", F.lit("!")).alias("source"))
    return by_text.unionByName(by_title)
