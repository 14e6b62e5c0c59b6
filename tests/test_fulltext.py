"""English stems, and search over postings."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import english
from tarn.operators import fulltext

#: Words of the published vocabulary with their stems.
STEMS = dict(
    x.split(":")
    for x in """consigned:consign consignment:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori consolidated:consolid consols:consol consonant:conson
    conspicuously:conspicu conspiracy:conspiraci conspirators:conspir conspired:conspir constables:constabl constancy:constanc knackeries:knackeri knaves:knave knavish:knavish kneaded:knead knees:knee
    kneeling:kneel knightly:knight knitting:knit knives:knive knockers:knocker knots:knot generally:general generate:generat communities:communiti happy:happi hopping:hop hoping:hope relational:relat
    conditional:condit rational:ration digitizer:digit licensing:licens skies:sky dying:die cries:cri ties:tie cry:cri by:by say:say gas:gas this:this gaps:gap kiwis:kiwi shed:shed luxuriated:luxuri
    agreed:agre feed:feed controlling:control rolling:roll possibly:possibl nationally:nation hopefulness:hope goodness:good formative:format adoption:adopt electricity:electr electrical:electr
    herring:herring proceed:proceed succeeds:succeed news:news youth:youth boyish:boyish saying:say flying:fli sing:sing singing:sing""".split()
)


@pytest.mark.parametrize("word", STEMS)
def test_stems_of_the_published_vocabulary(word):
    assert english.stem(word) == STEMS[word]


def test_stems_of_odd_words():
    assert [english.stem(w) for w in ("", "a", "is", "s", "zz", "y", "yyy", "aeiou", "naïve", "ing", "eed", "ly", "日本語")] == ["", "a", "is", "s", "zz", "y", "yyy", "aeiou", "naïv", "ing", "eed", "ly", "日本語"]
    r = random.Random(1)
    for _ in range(3000):
        w = "".join(r.choice("abdefilnostyuz'") for _ in range(r.randint(1, 12)))
        assert isinstance(english.stem(w), str)
    assert english.terms("The cats, the CAT's and cats_dogs; it isn't 42") == ["cat", "dog", "isn", "42"] and english.terms(None) == []


def corpus(n=400):
    r = random.Random(3)
    words = "boat boats sailing sailed harbour harbours tide tides red reddish quickly quick generals license licensed the of and".split()
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i * 3, " ".join(r.choices(words, weights, k=r.randint(1, 15)))) for i in range(n)] + [(1, None), (2, ""), (4, "the of"), (None, "boat tide"), (5, "boat " * 20_000), (6, "boat tide"), (6, "red")]


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_searches_equal_a_scan(spark, tmp_path, blocks):
    docs = spark.createDataFrame([(*d, "x") for d in corpus()], "doc_id long, text string, term string")
    index = fulltext.write_postings(fulltext.postings(docs, blocks=blocks), str(tmp_path / "postings"))
    assert all(r["ids"] == sorted(set(r["ids"])) and r["n"] == len(r["ids"]) for r in index.collect())
    have = {}
    for d, t in corpus():
        if d is not None:
            have.setdefault(d, set()).update(english.terms(t))
    for q in ("boat", "sails", "the boats of tides", "generally licensing harbour", "red quick tide boat", "boat nothing", "the of", "", "BOATS'"):
        wanted = set(english.terms(q))
        want = sorted(d for d, ts in have.items() if wanted and wanted <= ts)
        assert sorted(r["id"] for r in fulltext.search(index, q).collect()) == want
        scanned = {r["doc_id"] for r in docs.where("doc_id <> 6").where(fulltext.matches(F.col("text"), q)).collect()}
        assert scanned == {d for d in want if d != 6}
    plan = fulltext.search(index, "boat tide")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [boat,tide])]" in plan
    assert fulltext.search(fulltext.postings(docs.limit(0)), "boat").count() == 0


def test_titles_or_texts(spark):
    notes = spark.createDataFrame([(1, "Red kite", "birds"), (2, None, "the kites fly"), (3, "x", "red"), (4, "y", None), (5, "50% off", "")], "id long, title string, body string")
    index = fulltext.postings(notes, "id", "body")
    for using in (None, index):
        found = lambda q: sorted(r["id"] for r in fulltext.title_or_text(notes, q, "id", "title", "body", using).collect())  # noqa: E731, B023
        assert found("KITE") == [1, 2] and found("red") == [1, 3] and found("flying kites") == [2] and found("nothing") == [] and found("0%") == [5]
        assert fulltext.title_or_text(notes, "kite", "id", "title", "body", using).columns == notes.columns


def test_postings_are_listed_in_the_tasks(spark, monkeypatch):
    """Ids of a repeated row count once, lists that a task sends in parts meet again, and writing them deals no rows anew."""
    monkeypatch.setattr(fulltext, "HELD_IDS", 3)
    rows = [(i, f"kite sea {'boat' if i % 2 else 'oar'}") for i in range(20)] + [(3, "kite sea boat"), (None, "kite"), (30, None)]
    index = fulltext.postings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), blocks=2)
    met = {}
    for r in index.collect():
        assert r["n"] == len(r["ids"]) and r["ids"] == sorted(set(r["ids"]))
        met.setdefault(r["term"], []).extend(r["ids"])
    assert {t: sorted(ids) for t, ids in met.items()} == {"kite": list(range(20)), "sea": list(range(20)), "boat": list(range(1, 20, 2)), "oar": list(range(0, 20, 2))}
    assert "Generate" not in index._jdf.queryExecution().executedPlan().toString()
