"""Chat formatting, exact dedup and URL rules against plain versions, with nulls, blanks, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import re

from pyspark.sql import functions as F

from tarn.llm import exact_dedup, queries
from tarn.llm.chat import escape, format_examples, read_back, unescape
from tarn.llm.exact_dedup import deduplicated, mark_copies
from tarn.llm.url_rules import Rule, judge_urls

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

TURNS = [
    (1, 0, "system", "be [brief]"),
    (1, 1, "user", "hi </s>"),
    (1, 2, "assistant", "[INST] ok \\o [/INST]"),
    (1, 3, "user", "bye"),
    (2, 0, "assistant", ""),
    (2, 0, "assistant", ""),
    (2, 1, "assistant", "x" * 300_000),
    (3, 0, "user", None),
    (4, None, None, None),
    (None, 0, "user", "no id"),
    (5, 1, "assistant", "b"),
    (5, 1, "assistant", "a"),
]


def test_chat_reads_back(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, example int")
    got = {r["conv_id"]: r for r in read_back(format_examples(df)).collect()}
    for conv in {t[0] for t in TURNS}:
        rows = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(t[3] for t in rows if t[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == sha("".join(f"{t[2]}\n{t[3]}\n" for t in rows))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_each_reply_has_all_turns_before(spark):
    df = spark.createDataFrame([t for t in TURNS if t[0] == 1], "conv_id long, turn long, role string, text string")
    rows = format_examples(df).orderBy("example").collect()
    assert [r["target_turn"] for r in rows] == [2, None]
    assert rows[1]["formatted"].startswith(rows[0]["formatted"].removesuffix("</s>"))
    r = rows[0]
    assert r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] == "\\oINST] ok \\bo \\o/INST]"


def test_escape_is_reversible(spark):
    texts = ["", "\\", "[", "<", "\\o", "\\\\b[<", "</s>[INST] ok [/INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and "[" not in r["e"] and "<" not in r["e"]


def test_chat_empty(spark):
    assert read_back(format_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


DOCS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (4, None), (8, ""), (7, "c"), (7, "c"), (None, "a b"), (None, "lone"), (1, "z " * 200_000), (2, "z  " * 200_000), (6, "a b ")]


def plain_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in docs:
        groups.setdefault(norm(t), []).append(d)
    least = {k: min((d is None, d or 0) for d in v) for k, v in groups.items()}
    return sorted((((d if d is not None else -1), (None if least[norm(t)][0] else least[norm(t)][1]), len(groups[norm(t)])) for d, t in docs), key=str)


def check_dedup(spark, digest):
    df = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, digest string, locator long")
    rows = mark_copies(df, digest).collect()
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"]) for r in rows), key=str) == plain_dedup(DOCS)
    assert sum(r["kept"] for r in rows) == len({(k, n) for _, k, n in plain_dedup(DOCS)})
    return rows


def test_dedup(spark):
    for r in check_dedup(spark, exact_dedup.sha256):
        assert r["digest"] == sha(re.sub(r"[\x20\x09-\x0D]+", " ", r["row"]["text"] or ""))


def test_dedup_compares_bytes_when_digests_clash(spark):
    check_dedup(spark, lambda c: F.lit("same"))


def test_dedup_keeps_columns_and_takes_empty(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a", "l")], "doc_id long, text string, kept string")
    assert [tuple(r) for r in deduplicated(df).collect()] == [(1, "a", "k")]
    assert deduplicated(df.limit(0)).columns == df.columns
    assert deduplicated(df.limit(0)).count() == 0


def test_store_carries_on(spark, tmp_path):
    """Rows that come in three calls are marked as if they had come at once; the stream reads each file once."""
    store, got = f"file://{tmp_path}/store", None
    for part in (DOCS[:5], DOCS[5:8], [], DOCS[8:]):
        df = spark.createDataFrame([(*d, "x") for d in part], "doc_id long, text string, locator string")
        got = mark_copies(df, store=store).collect()
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"]) for r in got), key=str) == plain_dedup(DOCS)
    state = exact_dedup.read_state(spark, f"{store}/state").collect()
    assert sum(r["group_size"] for r in state) == len(DOCS)
    files = {f.name for f in (tmp_path / "store" / "rows").glob("*.parquet")}
    assert {r["keep_locator"]["file"] for r in state} <= files


def test_dedup_of_hot_groups(spark):
    """Half of the rows are copies of one text; a weak digest makes them meet others."""
    docs = [(i, "same" if i % 2 else f"t{i}") for i in range(900)]
    for digest in (exact_dedup.sha256, lambda c: F.lit("same")):
        rows = mark_copies(spark.createDataFrame(docs, "doc_id long, text string"), digest).collect()
        assert {r["doc_id"] for r in rows if r["kept"]} == {1, *range(0, 900, 2)}
        assert all((r["keep_id"], r["group_size"]) == ((1, 450) if r["doc_id"] % 2 else (r["doc_id"], 1)) for r in rows)


RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("block", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"), Rule("allow", "org/"), Rule("block", "a.b.org/es/")]
URLS = [None, "", "x", "http://EXAMPLE.com/en/77?q#f", "https://m.example.com/en/8", "http://notexample.net/de/1", "http://n.et/net/de/", "http://example.net/de/8", "http://x.org", "http://a.b.org/es/1", "a://b://com/en/", "http://com/en/", "http://com/EN/", "http://org/es", "http://xcom/en/" + "y" * 100_000]


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.pattern), r.pattern), default=None)
    return host, path, best and best.pattern, best.verdict if best else "allow"


def test_verdicts_of_the_contract(spark, tmp_path):
    """One url a rule of the contract, and its longer exception; op5_url_rules has the contract's words."""
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://a.org/es/1", "http://a.net/fr/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in queries.op5_url_rules(spark, str(tmp_path)).collect())
    assert got == [(0, "com/en/", "block"), (1, "example.com/en/7", "allow"), (2, "net/de/", "allow"), (3, "example.net/de/8", "block"), (4, "org/es/", "block"), (5, None, "allow")]


def test_urls_inline_and_joined(spark):
    df = spark.createDataFrame([(i, u, "t", "h") for i, u in enumerate(URLS)] + [(0, None, "t", "h")], "page_id long, url string, tokens string, host string")
    want = sorted([(i, *plain_verdict(u)) for i, u in enumerate(URLS)] + [(0, *plain_verdict(None))], key=str)
    for inline in (1000, 0):
        assert sorted((tuple(r) for r in judge_urls(df, RULES, inline=inline).collect()), key=str) == want
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(df, []).collect()} == {"allow"}
