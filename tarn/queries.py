"""Queries of the library's own operators over the tables, and the SQL that they are compared with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import chunk_rules as R
from tarn.functions import text as X
from tarn.functions import tokens
from tarn.functions.vectors import literal
from tarn.operators import agent, assist, context, fusion, reconcile, relational, telemetry, terms
from tarn.plans import ingest
from tarn.providers import Offline
from tarn.session import table
from tarn.sources import logs
from tarn.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="tarn-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- relational --------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""")
def notes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.optional_filters(table(spark, sf_dir, "orders"), o_orderstatus="O", o_custkey=None)
    order = [(F.col("o_orderpriority") == "1-URGENT").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return relational.page(rows, order, 20, 50).select("o_orderkey", "o_orderpriority", "o_orderdate")


_STEM = """CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y'
WHEN regexp_matches(w, '(ches|shes|ses|xes|zes)$') AND length(w) > 4 THEN substr(w, 1, length(w) - 2)
WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END"""
_STOPS = ", ".join(f"'{w}'" for w in relational.STOP_WORDS)


@query(f"""WITH t AS (SELECT doc_id, source, list_transform(list_filter(regexp_extract_all(lower(coalesce("text", '')), '[a-z0-9_]+'),
  lambda w: length(w) > 1 AND w NOT IN ({_STOPS})), lambda w: {_STEM}) AS terms FROM documents)
SELECT doc_id, source ILIKE '%rc1%' AS in_title, list_has_all(terms, ['inea', 'edon']) AS in_text FROM t""")
def notes_ilike_or_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", relational.contains_text("source", "rc1").alias("in_title"), relational.full_text(F.col("text"), "the ineas of edons").alias("in_text"))


@query("""WITH names AS (SELECT l_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS tags
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(tags, '') AS tags FROM orders LEFT JOIN names ON o_orderkey = l_orderkey""")
def tag_agg_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    out = relational.with_names(table(spark, sf_dir, "orders"), bridge, table(spark, sf_dir, "part"), "o_orderkey", "p_partkey", "p_brand", "tags")
    return out.select("o_orderkey", F.array_join("tags", ",").alias("tags"))


@query("""WITH d AS (SELECT l_orderkey, max(l_linenumber) AS indexed_version FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderkey % 7 AS version, indexed_version FROM orders LEFT JOIN d ON o_orderkey = l_orderkey
WHERE indexed_version IS NULL OR indexed_version < o_orderkey % 7""")
def stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("version"))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("indexed_version"))
    return reconcile.stale_notes(notes, docs, ["o_orderkey"], None)


@query("""SELECT doc_id, quality, toxic FROM labels l
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND CASE WHEN d.n_chars < 500 THEN '' ELSE d."text" END <> '')""")
def orphan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "").otherwise(F.col("text")).alias("text"))
    return reconcile.orphans(table(spark, sf_dir, "labels"), notes, ["doc_id"], "text")


@query("""SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS chunk_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-01'
UNION SELECT o_orderkey, '*' FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-01'""")
def identity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("chunk_id"), F.col("l_shipdate").alias("date_value"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return reconcile.date_identities(dates, docs, at("1997-03-01"), at("1997-04-01"))


@query("""SELECT n_regionkey, count(*) AS folders, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""")
def folders_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.array_join(F.sort_array(F.collect_list("n_name")), ",")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("folders"), lists.alias("names"))


@query("""SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce("text", '')) <> ''""")
def message_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.eligible_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3""")
def last_n_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return relational.last_n(events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 3).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type FROM events GROUP BY user_id""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", w).alias("event_id"), F.max_by("event_type", w).alias("event_type"))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 3 = 1 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    which = F.col("c_custkey") % 3
    changes = rows.where(which < 2).select(
        "c_custkey",
        F.lit(None).cast("double").alias("c_acctbal"),
        F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("c_mktsegment"),
        F.when(which == 0, F.array(F.lit("c_acctbal"))).otherwise(F.array(F.lit("c_mktsegment"))).alias("fields"),
    )
    return relational.partial_update(rows, changes, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("""SELECT 'nation' AS kind, count(*) AS n FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    tables = {
        "nation": t("nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")),
        "customer": t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer")),
        "orders": t("orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order")),
    }
    gone = t("region").where("r_regionkey = 0").select(F.col("r_regionkey").alias("region"))
    left = relational.cascade_delete(tables, gone, [("nation", "region", "nation"), ("customer", "nation", "customer"), ("orders", "customer", "order")])
    out = None
    for name in tables:
        one = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH new AS (SELECT vec_id, label + 100 AS label, 2 AS version FROM embeddings WHERE vec_id % 4 = 0)
SELECT e.vec_id, coalesce(n.label, e.label) AS label, coalesce(n.version, 1) AS version FROM embeddings e LEFT JOIN new n USING (vec_id)
UNION ALL SELECT -1, 7, 2""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    new = points.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    extra = spark.sql("SELECT -1L AS vec_id, 7 AS label, 2 AS version")
    return relational.upsert(points, new.unionByName(extra), ["vec_id"], "version")


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS chunk_id, 'old' AS state FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def replace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.lit("old").alias("state"))
    new = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("chunk_id"), F.lit("new").alias("state"))
    return relational.replace_documents(points, new)


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS chunk_id, l_quantity FROM lineitem
WHERE l_orderkey % 11 = 3 OR (l_orderkey % 11 = 4 AND l_linenumber = 2)""")
def identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("chunk_id"), "l_quantity")
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    whole = keys.where("doc_id % 11 = 3").withColumn("chunk_id", F.lit("*"))
    return relational.by_identity(points, whole.unionByName(keys.where("doc_id % 11 = 4").withColumn("chunk_id", F.lit("2"))))


@query("""WITH t AS (SELECT DISTINCT source AS name, lang AS server FROM documents)
SELECT name, server, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN server || ':' || name ELSE name END AS qualified FROM t""")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("lang").alias("server")).distinct()
    return relational.qualified_names(tools)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderstatus NOT IN ('F')""")
def allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_allowed(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F"], ["F"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH a AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'delete' ELSE 'upsert' END AS action FROM orders),
s AS (SELECT l_orderkey AS doc_id, max(l_linenumber) AS stored_version FROM lineitem GROUP BY 1)
SELECT a.doc_id, a.version, a.action, coalesce(a.version < stored_version, false) OR (action = 'upsert' AND stored_version IS NULL) AS stale FROM a LEFT JOIN s USING (doc_id)""")
def stale_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    arrivals = table(spark, sf_dir, "orders").select(k.alias("doc_id"), (k % 7).alias("version"), F.when(k % 2 == 0, "delete").otherwise("upsert").alias("action"))
    stored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").alias("version"))
    return reconcile.stale_arrivals(arrivals, stored).drop("stored_version")


@query("""WITH f(path, own) AS (VALUES ('app', true), ('app.chat', true), ('app.chat.stream', true), ('app.ingest', false), ('app.ingest.dates', true), ('logs', true))
SELECT a.path, bool_and(b.own) AS effective FROM f a JOIN f b ON a.path = b.path OR starts_with(a.path, b.path || '.') GROUP BY a.path""")
def flag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spark.sql("SELECT * FROM VALUES ('app', true), ('app.chat', true), ('app.chat.stream', true), ('app.ingest', false), ('app.ingest.dates', true), ('logs', true) AS f(path, own)")
    return resolved_flags(flags)


def resolved_flags(flags: DataFrame) -> DataFrame:
    """A flag holds if it and all its ancestors do. Each flag meets its ancestors by equal paths, not by all pairs."""
    parts = F.split("path", r"\.")
    up = flags.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("ancestor"))
    return up.join(flags.select(F.col("path").alias("ancestor"), "own"), "ancestor").groupBy("path").agg(F.bool_and("own").alias("effective"))


# -- text --------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(regexp_replace(coalesce("text", ''), '([A-Za-z0-9_])-[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*([A-Za-z0-9_])', '\1\2', 'g')) AS repaired FROM documents""")
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.repair_hyphenation(F.coalesce("text", F.lit(""))), 256).alias("repaired"))


@query("""SELECT sha256(coalesce("text", '')) AS id, substr(sha256(coalesce("text", '')), 1, 16) AS fingerprint, source || '-' || CAST(doc_id AS VARCHAR) AS doc FROM documents""")
def sha_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.sha2(text, 256).alias("id"), X.fingerprint(text).alias("fingerprint"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("doc"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce("text", ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 237)) || '...' END AS preview, length(t) > 240 AS truncated FROM f""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(text).alias("preview"), (F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 240).alias("truncated"))


_LINES = r"""list_filter(list_transform(string_split_regex(coalesce("text", ''), '\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')), lambda x: x <> '')"""


def _some(items: str, *patterns: str) -> str:
    return f"len(list_filter({items}, lambda x: {' OR '.join(f"regexp_matches(x, '{p}')" for p in patterns)}))"


_BARE = r"regexp_replace(regexp_replace({}, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')"
_BARS = "length(x) - length(replace(x, '|', '')) >= 2"
_QUOTED = """((starts_with(x, '"') AND ends_with(x, '"') AND length(x) > 3) OR (starts_with(x, '>') AND length(x) > 1))"""
#: The rules in SQL: al are all lines of a text, own those that are not blank, inn those behind its leading headings.
_FLAGS = fr"""d AS (SELECT doc_id, {_BARE.format('coalesce("text", chr(32))')} AS t FROM documents),
al AS (SELECT doc_id, t, list_transform(string_split_regex(t, '\r\n|[\n\r\x0B\x0C\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_BARE.format("x")}) AS al FROM d),
own AS (SELECT *, list_filter(al, lambda x: x <> '') AS own, coalesce(list_position(list_transform(al, lambda x: NOT regexp_matches(x, '{R.HEADING}')), true), 0) AS k FROM al),
inn AS (SELECT *, CASE WHEN k > 0 AND len(list_filter(al[k:], lambda x: x <> '')) > 0 THEN list_filter(al[k:], lambda x: x <> '') ELSE own END AS inn FROM own),
n AS (SELECT *, array_to_string(inn, chr(10)) AS target, {_some("own", R.HEADING)} AS headings, {_some("own", R.QUESTION)} AS asks, {_some("own", R.ANSWER)} AS answers,
  {_some("own", R.EMAIL, R.PHONE, R.CONTACT_LABEL)} > 0 AS contact, {_some("own", R.DEFINITION)} AS terms, len(list_filter(inn, lambda x: {_BARS})) AS bars FROM inn),
q AS (SELECT *, asks >= 1 AND answers >= 1 AND abs(asks - answers) <= 1 AS faq FROM n),
flags AS (SELECT doc_id, t, len(own) > 0 AND headings = len(own) AS heading_only, regexp_matches(t, '{R.FENCED_JSON}') AS json_fenced, regexp_matches(t, '{R.FENCE}') AS code_fenced,
  ((starts_with(target, '{{') AND ends_with(target, '}}')) OR (starts_with(target, '[') AND ends_with(target, ']'))) AND (regexp_matches(target, '"[^"]+"\s*:') OR (regexp_matches(target, '"[^"]+"') AND length(target) > 10)) AS json,
  len(inn) >= 3 AND {_some("inn", R.CODE_STARTS, R.CODE_LINES)} >= 0.6 * len(inn) AS code,
  bars >= 0.6 * len(inn) AND len(list_filter(inn, lambda x: {_BARS} AND NOT regexp_matches(x, '{R.TABLE_RULE_LINE}'))) >= 2 AS "table", faq,
  len(list_distinct(list_transform(list_filter(range(1, len(own)), lambda i: regexp_matches(own[i], '{R.SPEAKER}') AND NOT regexp_matches(own[i + 1], '{R.NO_DIALOGUE}')), lambda i: lower({_BARE.format("regexp_replace(own[i], ':$', '')")})))) >= 2
   OR len(list_distinct(list_transform(list_filter(range(2, len(al) + 1), lambda i: regexp_matches(al[i], '{R.CLOCK}') AND regexp_matches(al[i - 1], '{R.NAME}')), lambda i: lower(al[i - 1])))) >= 2
   OR len(list_distinct(list_transform(list_filter(own, lambda x: regexp_matches(x, '{R.STAMPED}')), lambda x: lower(regexp_replace({_BARE.format("regexp_replace(x, '^[^]]*]', '')")}, ':+$', ''))))) >= 2 AS transcript,
  len(list_filter(inn, lambda x: {_QUOTED})) > 0 AND len(list_filter(inn, lambda x: {_QUOTED} OR regexp_matches(x, '{R.ATTRIBUTION}'))) = len(inn) AS quote, contact,
  NOT contact AND ({_some("own", R.STREET, R.STREET_BEFORE_NUMBER, R.CITY)} > 0 OR ({_some("own", R.POSTAL)} > 0 AND {_some("own", R.BUILDING)} > 0)) AS address,
  {_some("own[1:3]", R.APPENDIX)} > 0 AS appendix,
  NOT faq AND len(own) >= 2 AND terms >= 2 AND terms >= 0.5 * len(own) AND (headings = 0 OR len(list_filter(own, lambda x: regexp_matches(x, '{R.HEADING}') AND regexp_matches(x, '{R.GLOSSARY}'))) > 0) AS glossary,
  {_some("inn", R.ORDERED)} >= 2 AND {_some("inn", R.ORDERED)} >= 0.4 * len(inn) AS structured_list, {_some("inn", R.BULLET)} >= 2 AND {_some("inn", R.BULLET)} >= 0.6 * len(inn) AS list FROM q)"""


@query(f"""WITH {_FLAGS} SELECT doc_id, {", ".join(f'"{k}"' for k in R.RULES)} FROM flags""")
def rule_flags_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "documents").select("doc_id", R.rule_flags(F.col("text")).alias("f"))
    return flagged.select("doc_id", *[F.col(f"f.{k}").alias(k) for k in R.RULES])


_TYPE = "CASE WHEN t = '' THEN 'content' " + " ".join(f"WHEN \"{k}\" THEN '{R.RULE_TYPES.get(k, k)}'" for k in R.RULES) + " ELSE 'content' END"


@query(f"""WITH {_FLAGS} SELECT doc_id, {_TYPE} AS chunk_type FROM flags""")
def chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_chunk_type(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_type")


_LINE_SAMPLES = (
    "# Keel", "## Glossary", "", "Keel: the spine of a boat", "Mast - a pole", "Ana Lee:", "Ben:", "10:32 AM", "Cid Roe", "[10:20] Ana:", "[10:21:33] Ben:", "hello there", "1. one", "2.1 two", "(iv) four", "- item", "* [x] done", "> said",
    '"quoted words"', "— a poet", "Q: why", "A: so", "Email: a@b.org", "a@b.org", "+49 30 123 45 67", "12 Long Street", "Hauptstraße 5", "Springfield, IL 12345", "12345", "Floor 3", "Appendix B: tables", "| a | b |", "|---|---|", "| c | d |", "pip install x",
    "def f():", "x = 1", "return x", "SELECT 1", "{", '"k": 1,', "}", "[1]", "```json", "```sh", "```", "Words of plain prose here.", "~~~",
)


@query(f"""WITH documents AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, array_to_string(list_transform(range(1, 7), lambda i: list_extract({list(_LINE_SAMPLES)!r}, CAST((o_orderkey * (2 * i + 1) + o_custkey * i * i) % {len(_LINE_SAMPLES)} + 1 AS INTEGER))), chr(10)) AS "text" FROM orders), {_FLAGS}
SELECT doc_id, {_TYPE} AS chunk_type, {", ".join(f'"{k}"' for k in R.RULES)} FROM flags""")
def rules_on_mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on texts of six lines drawn from a list that has lines of every type."""
    samples = F.array(*[F.lit(x) for x in _LINE_SAMPLES])
    drawn = [F.element_at(samples, ((F.col("o_orderkey") * (2 * i + 1) + F.col("o_custkey") * i * i) % len(_LINE_SAMPLES) + 1).cast("int")) for i in range(1, 7)]
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *drawn).alias("text"))
    flagged = R.with_chunk_type(texts, "text").select("doc_id", "chunk_type", R.rule_flags(F.col("text")).alias("f"))
    return flagged.select("doc_id", "chunk_type", *[F.col(f"f.{k}").alias(k) for k in R.RULES])


_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"
_STRIP = r"regexp_replace(regexp_replace(x, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')"


@query(f"""WITH l AS (SELECT doc_id, list_filter({_LINES}, lambda x: length(x) - length(replace(x, '|', '')) >= 2 AND NOT regexp_matches(x, '{_RULE}')) AS ls FROM documents),
r AS (SELECT doc_id, list_transform(ls, lambda y: list_filter(list_transform(string_split(regexp_replace(y, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: {_STRIP}), lambda x: x <> '')) AS rs FROM l),
b AS (SELECT doc_id, rs, rs[1] AS h, list_filter(rs[2:], lambda y: len(y) = len(rs[1])) AS body FROM r)
SELECT doc_id, CASE WHEN len(rs) >= 2 THEN array_to_string(h, ',') ELSE '' END AS headers, CASE WHEN len(rs) >= 2 THEN len(flatten(rs[2:])) ELSE 0 END AS cells,
 CASE WHEN len(rs) >= 2 AND len(body) > 0 THEN 'Columns: ' || array_to_string(h, ', ') || '. Contains ' || len(body) || CASE len(body) WHEN 1 THEN ' row. ' ELSE ' rows. ' END
  || array_to_string(list_transform(body, lambda y: array_to_string(list_transform(list_zip(h, y), lambda z: z[1] || ' ' || z[2]), ', ') || '.'), ' ') ELSE '' END AS described FROM b""")
def described_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.array_join(X.table_headers(F.col("text")), ",").alias("headers"), F.size(X.table_cells(F.col("text"))).alias("cells"), X.described_table(F.col("text")).alias("described"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce("text", '')), '[a-z0-9_]+')) AS w FROM documents)
SELECT w AS word, {_STEM} AS stem FROM w WHERE length(w) > 1""")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce("text", ''), chr(10))) AS line, generate_subscripts(string_split(coalesce("text", ''), chr(10)), 1) AS section FROM documents),
w AS (SELECT doc_id, section, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS term FROM l),
g AS (SELECT doc_id, lower(term) AS key, count(*) AS occurrences, count(DISTINCT section) AS sections FROM w GROUP BY 1, 2 HAVING count(DISTINCT section) >= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sections DESC, occurrences DESC, length(key) DESC, key) AS place FROM g)
SELECT doc_id, key, occurrences, sections, place FROM p WHERE place <= 40""")
def term_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are dealt once, by document; all that follows groups by document and needs no other shuffle.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("section", "line"))
    words = lines.select("doc_id", "section", F.posexplode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), 0)).alias("at", "term"))
    placed = words.withColumn("position", F.struct("section", "at"))
    return terms.ranked_terms(placed, "doc_id", "section", "position").select("doc_id", "key", "occurrences", "sections", "place")


# -- vectors and fusion ------------------------------------------------------------------------------------------


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of point 0 stands for an embedded question."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {_COSINE} AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 50")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fusion.cosine_top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 50, "vec_id")
    return top.withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {_COSINE} AS score FROM embeddings WHERE label IN (1, 3)) ORDER BY score DESC, vec_id LIMIT 10")
def cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fusion.cosine_top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10, "vec_id", where=F.col("label").isin(1, 3))
    return top.withColumn("score", F.round("score", 6))


_TF = """t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce("text", '')), '[a-z0-9_]+'), lambda w: length(w) > 1)) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS weight FROM t WHERE term IN ('inea', 'thble', 'eauou') GROUP BY 1, 2),
i AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c GROUP BY 1),
s AS (SELECT doc_id, sum(weight * idf * CASE term WHEN 'inea' THEN 1.0 WHEN 'thble' THEN 0.5 ELSE 0.7 END) AS score FROM c JOIN i USING (term) GROUP BY 1)"""
SPARSE_QUERY = {"inea": 1.0, "thble": 0.5, "eauou": 0.7}


def sparse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), 0), lambda t: t.isin(*SPARSE_QUERY))).alias("term"))
    postings = words.groupBy("doc_id", "term").agg(F.count("*").alias("weight"))
    return fusion.sparse_scores(postings, SPARSE_QUERY, docs.count(), "doc_id").orderBy(F.round("score", 9).desc(), "doc_id").limit(50)


@query(f"WITH {_TF} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_hits(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {_TF},
d AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT vec_id, {_COSINE} AS score FROM embeddings) ORDER BY r LIMIT 50),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM s ORDER BY r LIMIT 50),
u AS (SELECT id, 1.0 / (60 + r) AS part FROM d UNION ALL SELECT id, 0.9 / (60 + r) FROM k)
SELECT id, round(sum(part), 9) AS rrf, count(*) AS sources FROM u GROUP BY id ORDER BY rrf DESC, id LIMIT 30""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = fusion.cosine_top_k(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), query_vector(spark, sf_dir), 50, "id")
    sparse = sparse_hits(spark, sf_dir).withColumnRenamed("doc_id", "id").withColumn("score", F.round("score", 9))
    hits, _ = fusion.multi_source({"dense": lambda: dense, "sparse": lambda: sparse}, ["id"])
    fused = fusion.rank_fused(hits, ["id"], top=None).select("id", F.round("rrf", 9).alias("rrf"), F.size("contributions").alias("sources"))
    return fused.orderBy(F.col("rrf").desc(), "id").limit(30)


@query(f"""WITH s AS (SELECT vec_id, label, {_COSINE} AS score FROM embeddings), l AS (SELECT label FROM s GROUP BY label ORDER BY round(avg(score), 9) DESC, label LIMIT 3)
SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label IN (SELECT label FROM l) ORDER BY score DESC, vec_id LIMIT 30""")
def two_stage_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, v = table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)
    from tarn.functions.vectors import cosine

    scored = points.select("vec_id", "label", cosine(F.col("embedding"), literal(v)).alias("score"))
    best = scored.groupBy("label").agg(F.round(F.avg("score"), 9).alias("s")).orderBy(F.col("s").desc(), "label").limit(3)
    return scored.join(best.select("label"), "label", "left_semi").orderBy(F.col("score").desc(), "vec_id").limit(30).withColumn("score", F.round("score", 6))


# -- context -----------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id, row_number() OVER w - 1 AS ordinal, count(*) OVER (PARTITION BY conv_id) AS total
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.linked(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", "turn")


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, length(coalesce("text", '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
f AS (SELECT conv_id, 0 AS back, 0 AS used, 0 AS taken, '' AS places FROM (SELECT DISTINCT conv_id FROM m)
 UNION ALL SELECT m.conv_id, m.back, CASE WHEN ok THEN f.used + m.n ELSE f.used END, CASE WHEN ok THEN f.taken + 1 ELSE f.taken END,
  CASE WHEN ok THEN CAST(m.turn AS VARCHAR) || CASE WHEN f.places = '' THEN '' ELSE ',' || f.places END ELSE f.places END
 FROM f JOIN (SELECT * FROM m) m ON m.conv_id = f.conv_id AND m.back = f.back + 1, LATERAL (SELECT f.used + m.n <= 900 AND f.taken < 6 AS ok) o)
SELECT conv_id, arg_max(places, back) AS places FROM f GROUP BY conv_id""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = context.bounded_history(turns, "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))), budget=900)
    return out.select("conv_id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, length(coalesce("text", '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS turn, 0 AS batch, 0 AS cnt, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT conv_id FROM m)
 UNION ALL SELECT m.conv_id, m.i, m.turn, CASE WHEN c THEN f.batch + 1 ELSE f.batch END, CASE WHEN c THEN 1 ELSE f.cnt + 1 END, CASE WHEN c THEN m.n ELSE f.used + m.n END
 FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1, LATERAL (SELECT f.cnt > 0 AND (f.cnt >= 3 OR f.used + m.n > 700) AS c) o)
SELECT conv_id, turn, batch FROM f WHERE i > 0""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("items"))
    zipped = F.arrays_zip(F.transform("items", lambda x: x["turn"]).alias("turn"), context.packed(F.col("items"), 3, 700).alias("batch"))
    return turns.select("conv_id", F.inline(zipped).alias("turn", "batch"))


@query("""SELECT l_orderkey AS note, min(l_linenumber) AS first_seen, max(l_quantity) AS best, count(*) AS matches, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS chunks FROM lineitem GROUP BY l_orderkey""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_linenumber").cast("string").alias("chunk"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("place"))
    return context.references(hits, "note", "chunk", "score", "place").withColumn("chunks", F.array_join(F.array_sort("chunks"), ","))


# -- agent -------------------------------------------------------------------------------------------------------

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(\"text\", '')), '[a-z0-9_]+'), lambda w: length(w) > 1))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS own FROM conversations),
p AS (SELECT a.conv_id, a.turn, max(CASE WHEN len(b.own) > 0 THEN len(list_intersect(a.own, b.own)) / CAST(len(list_distinct(list_concat(a.own, b.own))) AS DOUBLE) END) AS best
 FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1, 2)
SELECT t.conv_id, t.turn, round(CASE WHEN p.turn IS NULL THEN 1.0 WHEN len(t.own) = 0 THEN 0.5 ELSE 1 - coalesce(best, 0) END, 6) AS uniqueness
FROM t LEFT JOIN p ON t.conv_id = p.conv_id AND t.turn = p.turn""")
def artifact_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.coalesce("text", F.lit(""))).alias("own"))
    return agent.uniqueness_of(turns, "conv_id", "turn", "own").select("conv_id", "turn", F.round("uniqueness", 6).alias("uniqueness"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS own FROM documents)
SELECT doc_id, round(least(len(list_intersect(own, ['inea', 'the', 'onble'])) / sqrt(len(own) + 1.0), 1.0), 6) AS score FROM t""")
def tool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*[F.lit(x) for x in ("inea", "the", "onble")])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(agent.tool_overlap(X.tokens(F.coalesce("text", F.lit(""))), asked), 6).alias("score"))


@query("""SELECT event_id, round(exp(-greatest(epoch(TIMESTAMP '2024-02-01') - epoch(ts), 0) / 86400.0), 6) AS freshness FROM events""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.lit(1706745600) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", F.round(agent.freshness(age, 86400.0), 6).alias("freshness"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5""")
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.keep_best(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", 5)


# -- telemetry ---------------------------------------------------------------------------------------------------


def events_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def log_count_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.counts_by_window(events_utc(spark, sf_dir), "ts", "1 minute", ["event_type"])


@query("SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_percent FROM events GROUP BY user_id")
def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(telemetry.percent(F.col("event_type") == "error", F.lit(True)), 6).alias("error_percent"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = telemetry.value_by_window(events_utc(spark, sf_dir), "ts", "5 minutes", "value")
    return out.select("window_start", F.round("p95", 6).alias("p95"), F.round("mean", 6).alias("mean"))


_LE = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b:g}" for b in telemetry.BUCKETS)


@query(f'SELECT event_type, {_LE}, count(*) AS "count", round(sum(value), 4) AS "sum" FROM events GROUP BY event_type')
def http_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.histogram(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("sum", F.round("sum", 4))


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_utc(spark, sf_dir)
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    return telemetry.within_retention(events, "ts", F.lit(now).cast("timestamp_ntz")).select("event_id", "event_type")


@query("SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(at.schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern: a single file is no base path
    out, checkpoint = shared(spark, "window-counts"), shared(spark, "window-checkpoint")
    windows.run_to_table(windows.window_counts(stream, "ts", "1 minute", ["event_type"]), out, checkpoint)
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT conv_id, string_agg(coalesce("text", ''), '' ORDER BY turn) AS text, min(turn) AS first_at, count(*) AS deltas FROM conversations GROUP BY conv_id""")
def delta_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return windows.accumulated(turns, "conv_id", "turn", "text", "turn")


# -- around a retrieval ------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", assist.json_lookup(F.col("props"), "k").alias("k"))


@query("""SELECT conv_id, count(*) AS messages, CAST(sum(len(regexp_extract_all(coalesce("text", ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\v]')) + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assist.message_tokens(table(spark, sf_dir, "conversations"), "conv_id")


@query(f"""WITH t AS (SELECT conv_id, turn, length(coalesce("text", '')) AS score, {_TOKENS} AS words, left(coalesce("text", ''), 40) AS snippet FROM conversations),
k AS (SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list(words))))[1:25], ',') AS keywords, max(score) AS best, count(*) AS matches FROM t GROUP BY conv_id),
s AS (SELECT conv_id, snippet, min(turn) AS seen FROM t GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seen) AS place FROM s)
SELECT k.conv_id, best, matches, keywords, string_agg(snippet, '~' ORDER BY seen) AS snippets FROM k JOIN f ON k.conv_id = f.conv_id AND place <= 3 GROUP BY ALL""")
def note_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(text).alias("score"), X.tokens(text).alias("words"), F.substring(text, 1, 40).alias("snippet"))
    out = assist.note_evidence(hits, "conv_id", "score", "turn", "words", "snippet")
    return out.withColumn("keywords", F.array_join("keywords", ",")).withColumn("snippets", F.array_join("snippets", "~"))


@query("""SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", logs.sse("event_type", "props").alias("frame"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events")
def iso_nanos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("nanos"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(lower(coalesce("text", '')), '[ \t\n\r\f\v]+', ' ', 'g')), 300) AS cache_key, octet_length(encode(coalesce("text", ''))) AS note_size FROM documents""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.cache_key(text).alias("cache_key"), F.octet_length(text).cast("long").alias("note_size"))


@query("""SELECT p_partkey, array_to_string(list_filter([p_brand, '', p_type], lambda t: trim(t) <> ''), ',') AS tags FROM part""")
def tag_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.filter(F.array("p_brand", F.lit(""), "p_type"), lambda t: F.trim(t) != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


def _gather_sql(name: str, of: str, chosen: str, when: str, kind: str = "arg_min(kind, i)") -> str:
    """The chosen rows of ``of`` in a document, if there are two or more, joined where the first stands."""
    return f"""{name}_m AS (SELECT *, {when} AND {chosen} AS m FROM {of}),
{name}_c AS (SELECT *, count(*) FILTER (m) OVER d AS ms, min(i) FILTER (m) OVER d AS first FROM {name}_m WINDOW d AS (PARTITION BY doc_id)),
{name} AS (SELECT doc_id, any_value(w) AS w, CASE WHEN m AND ms > 1 THEN first ELSE i END AS i, CASE WHEN bool_and(m AND ms > 1) THEN {kind} ELSE arg_min(kind, i) END AS kind, string_agg(x, chr(10) || chr(10) ORDER BY {name}_c.i) AS x
  FROM {name}_c GROUP BY doc_id, CASE WHEN m AND ms > 1 THEN first ELSE i END)"""


def _typed_sql(source: str) -> str:
    """The typed split of texts without headings and fences, in SQL; ``source`` gives the relation ``documents``."""
    told = f"""len(ls) > 2 AND ends_with(ls[1], ':') AND len(list_filter(ls[2:], lambda y: regexp_matches(y, '^[-*+]\\s+'))) = 0 AND len(list_filter(ls[2:], lambda y: regexp_matches(y, '^[A-Z][A-Za-z''’-]+\\s+\\S'))) > 1"""
    atomic = "'address', 'contact', 'faq', 'glossary', 'json', 'list', 'quote', 'structured_list', 'heading_only', 'transcript'"
    return f"""WITH whole AS (WITH {source}{_FLAGS} SELECT row_number() OVER () AS n, doc_id, t, {_TYPE} AS w FROM flags),
ln AS (SELECT n, t, w, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM whole WHERE t <> ''),
raw AS (SELECT n, w, t, i, string_split(t, chr(10))[i] AS raw, {_BARE.format("string_split(t, chr(10))[i]")} AS x FROM ln),
k AS (SELECT *, CASE WHEN x = '' THEN 'blank' WHEN regexp_matches(x, '^[-*_]{{3,}}$') THEN 'divider' WHEN {_BARS} THEN 'table' ELSE 'prose' END AS kind FROM raw),
r AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY n ORDER BY i) THEN 0 ELSE 1 END AS new FROM k),
b AS (SELECT *, sum(new) OVER (PARTITION BY n ORDER BY i) AS run FROM r),
blocks AS (SELECT n, any_value(w) AS w, any_value(t) AS t, run, kind, {_BARE.format("string_agg(raw, chr(10) ORDER BY i)")} AS x, list(x ORDER BY i) AS ls FROM b WHERE kind <> 'blank' GROUP BY n, run, kind),
prose AS (WITH documents AS (SELECT n * 1000000 + run AS doc_id, x AS "text" FROM blocks WHERE kind = 'prose'), {_FLAGS} SELECT doc_id AS id, {_TYPE} AS p FROM flags),
typed AS (SELECT b.n, b.w, b.t, b.run, b.kind AS block, b.x, CASE WHEN b.kind <> 'prose' THEN b.kind WHEN {told} THEN 'transcript' ELSE p.p END AS kind, p.p FROM blocks b LEFT JOIN prose p ON p.id = b.n * 1000000 + b.run),
one AS (SELECT n, bool_and(block = 'divider') AS none, (any_value(w) IN ('code', 'table') AND NOT contains(any_value(t), chr(10) || chr(10))) OR any_value(w) IN ({atomic}) OR (any_value(w) = 'content' AND bool_and(block = 'prose' AND p <> 'code')) AS whole FROM typed GROUP BY n),
seq AS (SELECT *, lag(kind) OVER (PARTITION BY n ORDER BY run) AS before FROM typed WHERE n IN (SELECT n FROM one WHERE NOT whole AND NOT none)),
cut AS (SELECT *, sum(CASE WHEN kind = 'content' AND before = 'content' THEN 0 ELSE 1 END) OVER (PARTITION BY n ORDER BY run) AS part FROM seq),
fold AS (SELECT n AS doc_id, any_value(w) AS w, min(run) AS i, any_value(kind) AS kind, string_agg(x, chr(10) || chr(10) ORDER BY run) AS x FROM cut WHERE kind <> 'divider' GROUP BY n, part),
{_gather_sql("g1", "fold", f"(kind = 'transcript' OR regexp_full_match(string_split(x, chr(10))[1], '(?:\\[\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\]\\s+)?[A-Z][^\\n:]{{0,60}}:\\s*'))", "w = 'transcript'", "'transcript'")},
{_gather_sql("g2", "g1", "kind IN ('list', 'structured_list')", "true")},
mixed AS (SELECT *, bool_or(kind IN ('code', 'json', 'table')) OVER d AS hard, bool_or(kind IN ('list', 'structured_list', 'transcript')) OVER d AS soft FROM g2 WINDOW d AS (PARTITION BY doc_id)),
{_gather_sql("g3", "mixed", "kind = 'content'", "NOT hard AND soft")},
every AS (SELECT doc_id AS n, i, kind, x FROM g3 UNION ALL SELECT n, 0, w, t FROM whole JOIN one USING (n) WHERE whole AND NOT none)
SELECT doc_id, CAST(row_number() OVER d - 1 AS INTEGER) AS chunk_index, count(*) OVER (PARTITION BY every.n) AS total, kind AS chunk_type, x AS "text", '' AS path FROM every JOIN whole ON every.n = whole.n WINDOW d AS (PARTITION BY every.n ORDER BY i)"""


@query(_typed_sql(""))
def typed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.typed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BLOCK_SAMPLES = (
    "", "", "", "---", "-*-", "====", "Words of plain prose here.", "And more of them there.", "- item", "* [x] done", "1. one", "2. two", "| a | b |", "|---|---|", "| c | d |", "Ana Lee:", "Ben:", "hello there", "So they spoke:",
    "Anna asked for it.", "Peter gave it.", "> said", "Q: why", "A: so", "Keel: the spine of a boat", "12 Long Street", "a@b.org", "pip install x", "x = 1", "return x", '"k": 1,', "{", "}",
)
_MIXED_BLOCKS = f"""documents AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, array_to_string(list_transform(range(1, 13), lambda i: list_extract({list(_BLOCK_SAMPLES)!r}, CAST((o_orderkey * (2 * i + 1) + o_custkey * i * i) % {len(_BLOCK_SAMPLES)} + 1 AS INTEGER))), chr(10)) AS "text" FROM orders), """


@query(_typed_sql(_MIXED_BLOCKS))
def typed_chunks_of_mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed split of texts of twelve lines, blank ones, dividers and table rows among them, drawn by the keys of orders."""
    samples = F.array(*[F.lit(x) for x in _BLOCK_SAMPLES])
    drawn = [F.element_at(samples, ((F.col("o_orderkey") * (2 * i + 1) + F.col("o_custkey") * i * i) % len(_BLOCK_SAMPLES) + 1).cast("int")) for i in range(1, 13)]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey")  # its files may be few
    return ingest.typed_chunks(orders.select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *drawn).alias("text")))


def tokenizer(spark: SparkSession) -> tokens.BytePairs:
    """Byte pairs by the ranks of a public vocabulary file."""
    import public_tokenizers

    return tokens.byte_pairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query()
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text, and its windows of 400 with 40 of the one before: how many, and a digest of them in order."""
    pairs = tokenizer(spark)
    cut = tokens.counted_windows(pairs, F.col("text"), 400, 40).alias("cut")
    docs = table(spark, sf_dir, "documents").select("doc_id", cut).select("doc_id", "cut.tokens", F.col("cut.windows").alias("w"))
    return docs.select("doc_id", "tokens", F.size("w").alias("windows"), F.sha2(F.array_join("w", "\n"), 256).alias("windows_sha256"))


@query()
def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = Offline(tokenizer=tokenizer(spark))
    return ingest.index_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), provider=provider)
