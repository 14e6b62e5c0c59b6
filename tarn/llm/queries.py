"""Queries over the intended tables, with production parameters, and the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.chat import format_examples, read_back
from tarn.llm.common import table
from tarn.llm.exact_dedup import mark_copies
from tarn.llm.fim import fill_in_middle, restore
from tarn.llm.html_model import extract_text
from tarn.llm.lexical import search
from tarn.llm.mixing import mixed
from tarn.llm.ngram_groups import link_components
from tarn.llm.pieces import encode_decode
from tarn.llm.ppm import fit as fit_ppm
from tarn.llm.ppm import predict
from tarn.llm.spot_signatures import edited_likeness
from tarn.llm.toxicity import fit as fit_toxicity
from tarn.llm.toxicity import score as score_toxicity
from tarn.llm.url_rules import Rule, judge_urls
from tarn.llm.warc import archived_pages

URL_RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_examples(turns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).drop("target_uri")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), piece_model(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_html_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated, mix = mixed(docs, table(spark, sf_dir, "labels"))
    posteriors = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mix.domains)]
    totals = [F.lit(float(x)).alias(f"{name}_{d}") for name, values in (("target", mix.targets), ("reached", mix.reached)) for d, x in zip(mix.domains, values, strict=True)]
    return rated.select("doc_id", "tokens", *posteriors, "rate", "expected_tokens", "copies", *totals)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_ppm(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_groups": op4_ngram_groups,
    "op5_url_rules": op5_url_rules,
    "op6_toxicity": op6_toxicity,
    "op7_pieces": op7_pieces,
    "op8_html_model": op8_html_model,
    "op9_spot_signatures": op9_spot_signatures,
    "op10_mixing": op10_mixing,
    "op11_lexical": op11_lexical,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language": op13_language,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    row_number() OVER w AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(txt)
      + (length(role) - length(replace(replace(replace(role, '\', ''), '[', ''), '<', '')))
      + (length(txt) - length(replace(replace(replace(txt, '\', ''), '[', ''), '<', '')))
      + length('[INST][TEXT][/INST]') AS chars
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) + length('<s></s>') AS upto FROM sized
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN txt ELSE '' END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples
FROM summed GROUP BY conv_id
""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> keep THEN keep END AS refers_to
FROM g
""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op5_url_rules": r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), hits AS (
  SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, r.rule) AS place
  FROM u LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE place = 1
""",
    "op11_lexical": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE "text" IS NOT NULL
), counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, corpus GROUP BY term, docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), queries AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (
  SELECT item_id, c.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM queries JOIN weights USING (term) JOIN counted c USING (term) JOIN sized USING (doc_id), corpus
  GROUP BY item_id, c.doc_id
)
SELECT item_id, row_number() OVER w AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20
""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce("text", '') AS txt, regexp_extract_all(coalesce("text", ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id::VARCHAR) AS h FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2, ('0x' || h[25:32])::BIGINT % 100 AS turn FROM d
), cut AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix,
    CASE WHEN txt = '' OR contains(txt, '<P>') OR contains(txt, '<S>') OR contains(txt, '<M>') THEN 'plain' WHEN turn < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN txt WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(txt) AS restored_sha256
FROM cut
""",
}
