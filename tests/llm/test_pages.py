"""WARC round trips and the DOM model."""

import gzip
import hashlib
import io

from pyspark.sql import functions as F

from tarn.llm import html_model, warc

PAGES = [(4, "http://a/", "x" * 200), (2, "http://b/ \r\nX: y", "x" * 200), (9, None, "x" * 200), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "y" * 150), (3, "u", "é" * 60), (3, "u", "é" * 60), (10, "u", "z" * 3_000_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*p, "d", 1) for p in rows], "page_id long, url string, html string, digest string, n int")


def test_round_trip(spark):
    rows = warc.archived_pages(pages(spark).repartition(3)).collect()
    assert len(rows) == len(PAGES)
    body = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in rows:
        data = body[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        ids = [p[0] for p in PAGES if (p[2] or "").encode() == data and p[0] is not None]
        copy = len(data) >= 100 and r["page_id"] is not None and r["page_id"] != min(ids)
        assert (r["record_type"], r["refers_to"]) == (("revisit", min(ids)) if copy else ("response", None))
    assert warc.archived_pages(pages(spark).limit(0)).count() == 0


def test_filters_are_pushed_and_ranges_split(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/w"
    warc.write_archives(warc.with_roles(pages(spark)), folder)
    for size in (37, 1000, 1 << 30):
        df = warc.read_archives(spark, folder)
        df = spark.read.format("warc").option("rangebytes", size).load(folder)
        assert df.count() == len(PAGES)
        some = df.where((F.col("record_type") == "revisit") & F.col("target_uri").isin("http://a/", "u"))
        assert [r["refers_to"] for r in some.collect()] == ["<urn:x-page:2>"]
    assert spark.read.format("warc").option("payload", "false").load(folder).where("payload IS NOT NULL").count() == 0
    wanted = warc.Wanted()
    assert wanted.take(warc.EqualTo(("record_type",), "revisit")) and not wanted.take(warc.EqualTo(("payload_length",), 3))


def test_foreign_archives(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 9\r\n\r\nH\r\n\r\nbody\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(text)
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb") as g:
        g.write(text)
    (tmp_path / "b.warc.gz").write_bytes(out.getvalue() * 2)
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r["record_type"], bytes(r["payload"])) for r in rows) == [("response", b"body")] * 3 + [("warcinfo", b"abc")] * 3


def test_main_text_of_layouts():
    model = html_model.trained_model()
    text = "The harbour froze in March, and the boats stayed on land for weeks."
    rest = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div>'
    for body in (f"<article><h1>Ice</h1><p>{text}<p>More&amp;more</article>", f"<main><h1>Ice</h1><p>{text}</p><p>More&amp;more</p></main>", f'<div class="content"><h1>Ice</h1><p>{text}</p><p>More&amp;more</p></div>'):
        html = f"<html><head><title>t</title><script>var p='<p>no</p>'</script></head><body>{rest}{body}<section id=comments><h3>Replies</h3><div class=comment><p>first!</p></div></section><form><input></form><footer>&copy; us</footer></body></html>"
        assert html_model.main_text(html, model) == f"Ice {text} More&more"


def test_held_out_layouts():
    model, right, total = html_model.trained_model(), 0, 0
    for html in html_model.labelled_pages(60, seed=77):
        page = html_model.parse(html, labelled=True)
        labels = page.labels[:]
        for i, y in enumerate(labels):
            labels[i] = y if y is not None else labels[page.parents[i]] if i else 0
        right += sum((m >= 0.5) == bool(y) for m, y in zip(model.marginals(page), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = html_model.trained_model()
    page = html_model.parse("<div class=content><p>some text here</p><ul><li><a>x</a></li></ul></div><p>tail")
    u, n, kinds = [model.unary(f) for f in html_model.node_features(page)], len(page.tags), page.kinds()
    weight = lambda y: math.exp(sum(u[i] * y[i] for i in range(n)) + sum(model.tables[kinds[i]][y[page.parents[i]]][y[i]] for i in range(1, n)))
    every = [(y, weight(y)) for y in itertools.product((0, 1), repeat=n)]
    z = sum(w for _, w in every)
    for i, m in enumerate(model.marginals(page)):
        assert abs(m - sum(w for y, w in every if y[i]) / z) < 1e-9


def test_extract_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>cut &am"), (4, "u", "<p"), (5, "u", "<<>> </x> <!-- open"), (5, "u", "<article>" + "<p>wo rd</p>" * 50_000)]
    got = html_model.extract_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == by[2]["text"] == by[4]["text"] == "" and by[3]["text"] == "cut &am"
    assert max(r["n_chars"] for r in got) == 50_000 * 6 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_any_attribute_and_self_closed_elements():
    model = html_model.trained_model()
    one, two = "The harbour froze in March, and boats stayed on land.", "Nobody went to sea before the thaw of the ice."
    for between in ('<table><tr><td data-label="Price">', '<p data-label="0">', '<svg viewBox="0 0"/><p>', '<iframe src="x"><p>', '<script src="x"/><p>', "<noscript/><p>", '<a href="x><i></i></a><p>', "<template><p>"):
        assert html_model.main_text(f"<article><p>{one}</p>{between}{two}", model) == f"{one} {two}", between
    assert html_model.main_text(f"<article><p>{one}</p><script src='a'/>var a;</script><svg/><style>p</style><p>{two}</p></article>", model) == f"{one} {two}"


def test_long_odd_pages_take_linear_time():
    import time

    model, began = html_model.trained_model(), time.time()
    n = 100_000
    for html in ("<div>" * n + "</p>" * n, '<a "' * n, "<a" * n, "<svg>" * n, "<section><p><section>" + "<b>" * n + "<h1></h1>" * n, "<!--" * n, "<li>" * n, "<p><x-y>" * n):
        assert html_model.main_text(html, model) == ""
    assert time.time() - began < 60


def test_unseen_names_and_no_names():
    model = html_model.trained_model()
    text = ["A frozen harbour", "The harbour froze in March, and the boats stayed on land for weeks.", "Nobody went to sea before the thaw, and prices in the market rose by half."]
    links = "".join(f'<li><a href="/{i}">topic {i}</a></li>' for i in range(6))
    for attr in ("", ' class="zq1"', ' id="qqr-7"'):
        html = f"<body><div{attr}><ul>{links}</ul></div><div{attr}><h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p></div><div{attr}>&copy; 2020 them</div></body>"
        assert html_model.main_text(html, model) == " ".join(text)


def test_pages_equal_their_articles(spark):
    """The tables mark the article by its element; a plain cut of the page is the truth."""
    import html as html_lib
    import re

    pages_of = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages_of.collect()}
    rows = html_model.extract_text(pages_of).collect()
    assert len(rows) == len(raw)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html_lib.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))).split())


def test_extract_from_nothing(spark):
    assert html_model.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = html_model.extract_text(spark.createDataFrame([(None, None, None), (None, None, None)], "page_id long, url string, html string")).collect()
    assert [tuple(r) for r in rows] == [(None, None, "", 0)] * 2


def test_large_ids_beside_nulls_come_back_whole(spark):
    ids = [(1 << 60) + 1, None, (1 << 60) + 3, -(1 << 63)]
    df = spark.createDataFrame([(i, "u", f"<html><body><p>The text of page {n} goes on for a while and ends.</p></body></html>") for n, i in enumerate(ids)], "page_id long, url string, html string").repartition(1)
    got = {r["text"].split()[4] if r["text"] else None: r["page_id"] for r in html_model.extract_text(df).collect()}
    assert sorted(got.values(), key=str) == sorted(ids, key=str)


def test_hidden_text_and_bare_prose():
    model = html_model.trained_model()
    words = "The ferry crossed the bay in the morning and came back late. " * 6
    page = '<html><body><nav><a href="/">Home</a></nav><article><p>{}</p>{}<p>{}</p></article></body></html>'
    shown = html_model.main_text(page.format(words, f"<p>Middle part. {words}</p>", words), model)
    assert "Middle part" in shown
    for hidden in ("<div hidden><p>Middle part. {}</p></div>", '<p style="color: red; display: none">Middle part. {}</p>', "<p hidden=''>Middle <b>part.</b> {}</p>"):
        got = html_model.main_text(page.format(words, hidden.format(words), words), model)
        assert "Middle" not in got and got.count("ferry") == 12
    assert "Middle part" in html_model.main_text(page.format(words, f'<p class="overflow-hidden">Middle part. {words}</p>', words), model)
    assert html_model.main_text(" Prose without &amp; any\n tag.  ", model) == "Prose without & any tag." and html_model.main_text("", model) == ""
