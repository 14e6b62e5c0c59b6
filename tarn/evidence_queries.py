"""Queries of text and neighbour functions over values of the tables in many forms, and the SQL that states what they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import python_tier as P
from tarn.functions import term_words
from tarn.functions import text as X
from tarn.operators import context
from tarn.queries import query
from tarn.session import table


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || chr(10) || 'total ' || o_custkey || chr(10) || 'status ' || o_orderstatus WHEN 1 THEN o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'item ' || o_custkey ELSE '' END
  WHEN 2 THEN 'status ' || o_orderstatus || o_custkey ELSE '' END AS text FROM orders""")
def editor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of editor documents: headings, hard breaks, lists with and without items, marks side by side, and what is no document."""
    node = lambda kind, *inner: F.concat(F.lit(f'{{"type": "{kind}", "content": ['), F.concat_ws(", ", *inner), F.lit("]}"))
    said = lambda c: F.concat(F.lit('{"type": "text", "text": "'), c, F.lit('"}'))
    total, status, k = F.concat(F.lit("total "), F.col("o_custkey").cast("string")), F.concat(F.lit("status "), F.col("o_orderstatus")), F.col("o_orderkey") % 4
    item = node("listItem", node("paragraph", said(F.concat(F.lit("item "), F.col("o_custkey").cast("string")))))
    items = F.when(F.col("o_custkey") % 2 == 0, item).otherwise(F.lit('{"type": "listItem"}'))
    whole = node("doc", node("heading", said(F.col("o_orderpriority"))), node("paragraph", said(total), F.lit('{"type": "hardBreak"}'), said(status)))
    listed = node("doc", node("paragraph", said(F.col("o_orderpriority"))), node("bulletList", items))
    marked = node("doc", node("paragraph", said(status), F.lit('{"type": "text", "text": null}'), said(F.col("o_custkey").cast("string"))), F.lit('{"type": "horizontalRule"}'))
    raw = F.when(k == 0, whole).when(k == 1, listed).when(k == 2, marked).otherwise(F.concat(F.lit("{"), whole))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.tree_text(raw).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '# ' || p_brand || '.' WHEN 1 THEN 'Section one.' || chr(10) || p_brand || ' is here.' WHEN 2 THEN 'Size ' || p_size || '.' || chr(10) || 'and ' || lower(p_brand)
  WHEN 3 THEN 'A | B' || chr(10) || p_brand || '!' ELSE '2.1 Size ' || p_size || '.' || chr(10) || 'This label of a part has far too many words to be one ' || p_brand END AS text FROM part""")
def separated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and short labels closed as sentences; table rows, sentences and long lines as they are."""
    k, brand, size = F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("# "), brand)).when(k == 1, F.concat(F.lit("Section one:\n"), brand, F.lit(" is here."))).when(k == 2, F.concat(F.lit("Size "), size, F.lit("\nand "), F.lower(brand)))
        .when(k == 3, F.concat(F.lit("A | B\n"), brand, F.lit("!"))).otherwise(F.concat(F.lit("2.1 Size "), size, F.lit("\nThis label of a part has far too many words to be one "), brand))
    )
    return table(spark, sf_dir, "part").select("p_partkey", X.headings_separated(text).alias("text"))


_NEAR = """CASE WHEN strpos(lower(t), word) > 0 THEN substr(t, greatest(strpos(lower(t), word) - 40, 1), strpos(lower(t), word) + length(word) + 40 - greatest(strpos(lower(t), word) - 40, 1)) ELSE substr(t, 1, 80) END"""


@query(f"""WITH d AS (SELECT doc_id, coalesce("text", '') AS t, CASE doc_id % 3 WHEN 0 THEN 'license' WHEN 1 THEN 'the' ELSE 'stupid' END AS word FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(replace({_NEAR}, chr(10), ' '), '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '') AS context FROM d""")
def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty characters on both sides of a word's first place, whatever its case, or the text's beginning."""
    word = F.element_at(F.array(F.lit("LICENSE"), F.lit("The"), F.lit("stupid")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.entity_context(F.coalesce("text", F.lit("")), word, 40).alias("context"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_shipdate, l_returnflag FROM lineitem),
e AS (SELECT doc_id, n, 'kept ' || n AS "text" FROM c WHERE l_returnflag = 'N' UNION ALL SELECT doc_id, n, 'skipped ' || n FROM c WHERE l_returnflag = 'R' AND (doc_id, n) NOT IN (SELECT (doc_id, n) FROM c WHERE l_returnflag = 'N'))
SELECT s.doc_id, CAST(s.n AS VARCHAR) AS chunk_id, p."text" AS prev_text, x."text" AS next_text FROM c s LEFT JOIN e p ON p.doc_id = s.doc_id AND p.n = s.n - 1 LEFT JOIN e x ON x.doc_id = s.doc_id AND x.n = s.n + 1 WHERE s.l_returnflag = 'N'""")
def neighbour_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beside chunks, from the index or else from the chunks that it skipped; those of one flag are in neither."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), "l_returnflag")
    named = rows.withColumn("chunk_id", F.col("n").cast("string"))
    kept = named.where("l_returnflag = 'N'").withColumn("text", F.concat(F.lit("kept "), F.col("chunk_id")))
    # What the index has is not taken from the skipped ones.
    skipped = named.where("l_returnflag IN ('R', 'N')").withColumn("text", F.concat(F.lit("skipped "), F.col("chunk_id")))
    seeds = kept.select("doc_id", "chunk_id", (F.col("n") - 1).cast("string").alias("prev_id"), (F.col("n") + 1).cast("string").alias("next_id"))
    return context.with_neighbours(seeds, kept, skipped).select("doc_id", "chunk_id", "prev_text", "next_text")


@query(r"""WITH t AS (SELECT event_id, list_distinct(regexp_extract_all('seen ' || event_id || ', ' || (event_id % 7) || '%, then ' || (user_id % 9) || ' of ' || (event_id % 1000), '[0-9]+%?')) AS said,
  list_concat(regexp_extract_all('asked of ' || user_id || ' and ' || (event_id % 7) || '%', '[0-9]+%?'), [CAST(user_id % 9 AS VARCHAR)]) AS asked FROM events)
SELECT event_id, len(list_filter(said, lambda x: NOT list_contains(asked, x))) AS invented FROM t""")
def invented_numbers_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four numbers in an answer, percentages among them, those that the question has not."""
    s = lambda c: c.cast("string")
    e, u = F.col("event_id"), F.col("user_id")
    said = F.concat(F.lit("seen "), s(e), F.lit(", "), s(e % 7), F.lit("%, then "), s(u % 9), F.lit(" of "), s(e % 1000))
    asked = F.concat(F.lit("asked of "), s(u), F.lit(" and "), s(e % 7), F.lit("% and "), s(u % 9))
    return table(spark, sf_dir, "events").select("event_id", F.size(X.invented_numbers(said, asked)).alias("invented"))


@query("""SELECT event_id, round(least(1.0, CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 5 < 3 THEN 0.6 ELSE 0.1 END
  ELSE 0.2 + CASE WHEN user_id % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0.15 ELSE 0 END + CASE WHEN user_id % 5 < 3 THEN 0.2 ELSE 0 END + CASE WHEN event_id % 7 < 2 THEN 0.1 ELSE 0 END END), 6) AS actionability FROM events""")
def actionability_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with and without ids, success, rows and names, in all combinations, and lists with and without entries."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = F.concat(F.lit("["), F.when(u % 5 < 3, "1").otherwise(""), F.lit("]"))
    parts = F.concat_ws(", ", F.lit('"n": 1'), F.when(u % 2 == 0, '"chunk_id": 4'), F.concat(F.lit('"ok": '), F.when(e % 5 == 0, "true").otherwise("false")), F.concat(F.lit('"items": '), rows), F.when(e % 7 < 2, '"url": "x"'))
    return table(spark, sf_dir, "events").select("event_id", F.round(P.actionability(F.when(e % 3 == 0, rows).otherwise(F.concat(F.lit("{"), parts, F.lit("}")))), 6).alias("actionability"))


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce("text", ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 6)) AS i FROM w),
p AS (SELECT doc_id, CAST(i // 6 AS INTEGER) AS place, array_to_string(ws[i + 1:i + 6], ' ') AS phrase FROM s),
a AS (SELECT *, regexp_replace(phrase, '([\\pL\\pN_])- +([\\pL\\pN_])', '\\1\\2', 'g') AS closed FROM p),
b AS (SELECT *, trim(regexp_replace(CASE WHEN contains(closed, '|') THEN array_to_string(list_filter(list_transform(string_split(regexp_replace(closed, '^ *\\|?[-: ]+\\|[-|: ]+\\|?', ' '), '|'), lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE closed END, ' +', ' ', 'g')) AS flat FROM a),
c AS (SELECT *, string_split(flat, ' ') AS t, list_transform(string_split(flat, ' '), lambda x: lower(x) IN ({_listed(term_words.EDGE_WORDS)})) AS edge FROM b),
d AS (SELECT *, coalesce(nullif(list_position(edge, false), 0), len(t)) AS lo, coalesce(nullif(len(t) + 1 - list_position(list_reverse(edge), false), len(t) + 1), len(t)) AS hi FROM c),
e AS (SELECT *, array_to_string(t[lo:least(greatest(lo, hi), lo + 3)], ' ') AS term FROM d)
SELECT doc_id, place, CASE WHEN length(flat) < 3 OR regexp_full_match(flat, '[-:| ]+') OR length(term) < 3 OR ends_with(term, '-') OR (NOT contains(term, ' ') AND lower(term) IN ({_listed(term_words.NOISE_NOUNS | term_words.EDGE_WORDS)})) THEN NULL ELSE term END AS term FROM e""")
def cleaned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term of each run of six words of every text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws"))
    runs = docs.where(F.size("ws") > 0).select("doc_id", "ws", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 6).cast("int"))).alias("place"))
    return runs.select("doc_id", "place", term_words.clean_term(F.array_join(F.slice("ws", F.col("place") * 6 + 1, F.lit(6)), " "), spaced=True).alias("term"))
