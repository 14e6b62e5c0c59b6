"""Queries over date phrases, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import dates
from tarn.plans import enrich
from tarn.queries import query
from tarn.session import table

_ZONES = ("UTC", "America/New_York", "Europe/Berlin", "Asia/Tokyo")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a date phrase of twelve kinds, made of orders' dates and keys; base instants from noon on, in four zones."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    r = F.date_add(day, (k % 400 - 200).cast("int"))
    told = lambda form: F.date_format(r, form)
    kinds: list[Column] = [
        told("yyyy-MM-dd"), told("d MMMM yyyy"), told("MMMM d, yyyy"), told("MMMM yyyy"), F.concat((k % 9 + 1).cast("string"), F.lit(" days ago")), F.concat(F.lit("in "), (k % 5 + 1).cast("string"), F.lit(" months")),
        F.lit("last month"), F.concat(F.lit("next "), told("EEEE")), F.lit("yesterday"), told("MMMM"), F.concat(F.lit("last "), told("MMMM")), F.concat(told("yyyy-MM-dd"), F.lit(" at "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30")),
    ]
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.floor(k / 12) % 4 + 1).cast("int"))
    phrase = F.element_at(F.array(*kinds), (k % 12 + 1).cast("int"))
    base = day.cast("timestamp") + F.make_interval(hours=(k % 8 + 12).cast("int"))
    return table(spark, sf_dir, "orders").select(k, zone.alias("zone"), base.alias("base"), F.concat(F.lit("What of this, written: "), phrase, F.lit(", was kept?")).alias("question"))


_SQL = f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 8 + 12 AS INTEGER)) AS base,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 200 AS INTEGER) AS DATE) AS r, (['{"', '".join(_ZONES)}'])[CAST(o_orderkey // 12 % 4 + 1 AS INTEGER)] AS zone FROM orders),
l AS (SELECT *, base AT TIME ZONE 'UTC' AT TIME ZONE zone AS local FROM o),
m AS (SELECT *, k % 12 AS kind, CASE WHEN k % 12 = 10 AND month(r) >= month(local) THEN year(local) - 1 WHEN k % 12 = 3 THEN year(r) ELSE year(local) END AS y FROM l),
f AS (SELECT *, make_date(y, month(r), 1) AS first, CAST((dayofweek(r) - dayofweek(local) - 1 + 7) % 7 + 1 AS INTEGER) AS ahead FROM m),
v AS (SELECT *, CASE kind WHEN 0 THEN CAST(r AS TIMESTAMP) WHEN 1 THEN CAST(r AS TIMESTAMP) WHEN 2 THEN CAST(r AS TIMESTAMP)
    WHEN 4 THEN local - to_days(CAST(k % 9 + 1 AS INTEGER)) WHEN 5 THEN local + to_months(CAST(k % 5 + 1 AS INTEGER)) WHEN 6 THEN local - to_months(1)
    WHEN 7 THEN date_trunc('day', local) + to_days(ahead) WHEN 8 THEN local - to_days(1) WHEN 11 THEN CAST(r AS TIMESTAMP) + to_hours(CAST(k % 24 AS INTEGER)) + to_minutes(30)
    ELSE CAST(first AS TIMESTAMP) + to_days(CAST(least(day(local), day(last_day(first))) - 1 AS INTEGER)) END AS told,
  CASE kind WHEN 0 THEN strftime(r, '%Y-%m-%d') WHEN 1 THEN strftime(r, '%-d %B %Y') WHEN 2 THEN strftime(r, '%B %-d, %Y') WHEN 3 THEN strftime(r, '%B %Y') WHEN 4 THEN (k % 9 + 1) || ' days ago' WHEN 5 THEN 'in ' || (k % 5 + 1) || ' months'
    WHEN 6 THEN 'last month' WHEN 7 THEN 'next ' || dayname(r) WHEN 8 THEN 'yesterday' WHEN 9 THEN monthname(r) WHEN 10 THEN 'last ' || monthname(r) ELSE strftime(r, '%Y-%m-%d') || ' at ' || lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':30' END AS phrase FROM f),
u AS (SELECT *, told AT TIME ZONE zone AT TIME ZONE 'UTC' AS value FROM v)"""


@query(f"""{_SQL} SELECT k AS o_orderkey, phrase,
  CASE WHEN kind IN (3, 9, 10) THEN CAST(first AS TIMESTAMP) AT TIME ZONE zone AT TIME ZONE 'UTC' ELSE CAST(date_trunc('day', value) AS TIMESTAMP) END AS starts,
  CASE WHEN kind IN (3, 9, 10) THEN CAST(first + to_months(1) AS TIMESTAMP) AT TIME ZONE zone AT TIME ZONE 'UTC' ELSE CAST(date_trunc('day', value) AS TIMESTAMP) + to_days(1) END AS ends FROM u""")
def asked_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time that each question asks for: months in the user's zone, days in UTC."""
    found = _dated(spark, sf_dir).select("o_orderkey", dates.asked_range(F.col("question"), F.col("base"), F.col("zone")).alias("d"))
    return found.select("o_orderkey", "d.phrase", F.col("d.start").cast("timestamp_ntz").alias("starts"), F.col("d.end").cast("timestamp_ntz").alias("ends"))


@query(f"""{_SQL} SELECT k AS o_orderkey, phrase AS date_text, value AS date_value,
  CASE WHEN kind = 11 THEN 'time' WHEN kind IN (0, 1, 2, 4, 5) THEN 'day' WHEN kind = 3 THEN 'year' ELSE 'month' END AS date_precision,
  CASE WHEN kind IN (4, 6, 7, 8, 10) THEN 'relative' ELSE 'absolute' END AS date_type FROM u""")
def phrase_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that texts name, as instants in UTC."""
    texts = _dated(spark, sf_dir).select("o_orderkey", F.lit("0").alias("chunk_id"), F.col("question").alias("text"), "base", "zone")
    found = enrich.phrase_dates(texts, "o_orderkey", F.col("base"), F.col("zone"))
    return found.select("o_orderkey", "date_text", F.col("date_value").cast("timestamp_ntz").alias("date_value"), "date_precision", "date_type")
