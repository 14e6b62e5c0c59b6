"""Dates in phrases: a small grammar over a text, read with a base instant and the user's zone.

The forms are alternatives of one pattern, the longer ones first, so that a text is searched once and a phrase belongs to
the first form that fits at its place. All is in built-in expressions; instants are UTC, and the session must be in UTC.
"""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import MONTH, TEMPORAL

#: Names of months, weekdays and small numbers, and what makes a phrase relative, timed, a day or a year.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
RELATIVE = r"(?i)\b(last|next|this|ago|yesterday|today|tomorrow)\b"
PRECISIONS = ((r"\d{1,2}:\d{2}", "time"), (r"\b\d{1,2}\b", "day"), (r"\b\d{4}\b", "year"))

_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
_FULL_MONTH = "(" + "|".join(MONTHS) + ")"
_WEEKDAY = "(" + "|".join(WEEKDAYS) + ")"
_NUMBER = r"(\d{1,4}|an?|" + "|".join(NUMBERS) + ")"
_UNIT = "(day|week|month|year)s?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?(?!\d|:)"
_TIME = r"(?:(?:\s+at\s+|,?\s+|t)(\d{1,2}):(\d{2}))?"
_YEAR = r"(?:,?\s+(\d{4}))?"
_TURN = "(last|next|this)"

#: Form to pattern, in the order in which they are tried.
FORMS = {
    "iso": rf"(\d{{4}})-(\d{{2}})-(\d{{2}}){_TIME}",
    "day_month": rf"{_DAY}\s+(?:of\s+)?{_MONTH}\b\.?{_YEAR}{_TIME}",
    "month_day": rf"{_MONTH}\b\.?\s+{_DAY}{_YEAR}{_TIME}",
    "month_year": rf"{_MONTH}\b\.?,?\s+(\d{{4}})",
    "slashed": r"(\d{1,2})/(\d{1,2})/(\d{4})",
    "ago": rf"{_NUMBER}\s+{_UNIT}\s+ago",
    "ahead": rf"in\s+{_NUMBER}\s+{_UNIT}",
    "from_now": rf"{_NUMBER}\s+{_UNIT}\s+from\s+(?:now|today)",
    "turn_unit": rf"{_TURN}\s+(week|month|year)",
    "turn_weekday": rf"{_TURN}\s+{_WEEKDAY}",
    "turn_month": rf"{_TURN}\s+{_FULL_MONTH}",
    "named_day": r"(day\s+before\s+yesterday|day\s+after\s+tomorrow|yesterday|today|tomorrow)",
    "weekday": _WEEKDAY,
    # The verb "may" is no month: alone it has to be written as a name, or to follow "in" or the like.
    "month": rf"(?!may\b){_FULL_MONTH}|(?-i:May)|(?<=\b(?:in|of|by|since|until|during)\s)may",
    "year": r"((?:19|20)\d{2})",
}
#: A phrase by itself no longer shows what it followed.
_ALONE = FORMS | {"month": _FULL_MONTH}
PHRASE = "(?i)\\b(?:" + "|".join(FORMS.values()) + ")\\b"


def _group(phrase: Column, form: str, n: int) -> Column:
    return F.regexp_extract(phrase, f"(?i)^(?:{_ALONE[form]})$", n)


def _is(phrase: Column, form: str) -> Column:
    return F.rlike(phrase, F.lit(f"(?i)^(?:{_ALONE[form]})$"))


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*(x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(i + 1))))
    return numbers[F.lower(F.substring(name, 1, 3))]


def _weekday_number(name: Column) -> Column:
    return F.create_map(*(x for i, w in enumerate(WEEKDAYS) for x in (F.lit(w), F.lit(i + 1))))[F.lower(name)]


def _number(word: Column) -> Column:
    named = F.create_map(*(x for i, w in enumerate(NUMBERS) for x in (F.lit(w), F.lit(i + 1))), F.lit("a"), F.lit(1), F.lit("an"), F.lit(1))
    return F.when(F.rlike(word, F.lit(r"^\d+$")), word.try_cast("int")).otherwise(named[F.lower(word)])


def _at(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None) -> Column:
    """That local time; null where there is none such."""
    clock = lambda c: F.lit("0") if c is None else F.when(c == "", "0").otherwise(c)
    said = F.concat_ws(" ", F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.concat_ws(":", clock(hour), clock(minute)))
    return F.try_to_timestamp(said, F.lit("y-M-d H:m"))


def _moved(local: Column, n: Column, unit: Column) -> Column:
    """``local`` moved by so many units, its time of day kept; from a month's end to a shorter month's end."""
    size = lambda name: F.when(F.lower(unit) == name, n).otherwise(F.lit(0))
    return local + F.make_interval(size("year"), size("month"), size("week"), size("day"))


def _same_day(local: Column, year: Column, month: Column) -> Column:
    """The base's day of the month, or the last one there is, in that month."""
    first = F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), F.lit("1")), F.lit("y-M-d"))
    return F.date_add(first.cast("date"), F.least(F.dayofmonth(local), F.dayofmonth(F.last_day(first))) - 1).cast("timestamp")


def local_value(phrase: Column, local: Column) -> Column:
    """The local time that a phrase of the grammar names when it is ``local``; null for a day that does not exist.

    A day and month without a year are of the base's year, a month or year alone has the base's day (and month).
    Weekdays are the latest up to today; ``last`` is the one before today, ``next`` the one behind it, ``this`` the next
    from today on. Named months with ``last`` and ``next`` are outside the base's month. Days have local midnight;
    what is counted from the base keeps its time of day.
    """
    g = lambda form, n: _group(phrase, form, n)
    year = F.year(local)
    or_this = lambda said: F.when(said == "", year.cast("string")).otherwise(said)
    today = F.date_trunc("day", local)
    days = lambda n: F.make_interval(days=n)
    turn = lambda form: F.lower(g(form, 1))
    back = F.pmod(F.dayofweek(local) - _weekday_number(g("weekday", 1)), F.lit(7))
    target = _weekday_number(g("turn_weekday", 2))
    before, behind = F.pmod(F.dayofweek(local) - target - 1, F.lit(7)) + 1, F.pmod(target - F.dayofweek(local) - 1, F.lit(7)) + 1
    named = _month_number(g("turn_month", 2))
    shift = F.when((turn("turn_month") == "last") & (named >= F.month(local)), -1).when((turn("turn_month") == "next") & (named <= F.month(local)), 1).otherwise(0)
    step = F.when(turn("turn_unit") == "last", -1).when(turn("turn_unit") == "next", 1).otherwise(0)
    said = F.regexp_replace(F.lower(phrase), r"\s+", " ")
    offset = F.create_map(*(F.lit(x) for x in ("day before yesterday", -2, "yesterday", -1, "today", 0, "tomorrow", 1, "day after tomorrow", 2)))[said]
    values = {
        "iso": _at(g("iso", 1), g("iso", 2), g("iso", 3), g("iso", 4), g("iso", 5)),
        "day_month": _at(or_this(g("day_month", 3)), _month_number(g("day_month", 2)), g("day_month", 1), g("day_month", 4), g("day_month", 5)),
        "month_day": _at(or_this(g("month_day", 3)), _month_number(g("month_day", 1)), g("month_day", 2), g("month_day", 4), g("month_day", 5)),
        "month_year": _same_day(local, g("month_year", 2), _month_number(g("month_year", 1))),
        "slashed": _at(g("slashed", 3), g("slashed", 1), g("slashed", 2)),
        "ago": _moved(local, -_number(g("ago", 1)), g("ago", 2)),
        "ahead": _moved(local, _number(g("ahead", 1)), g("ahead", 2)),
        "from_now": _moved(local, _number(g("from_now", 1)), g("from_now", 2)),
        "turn_unit": _moved(local, step, g("turn_unit", 2)),
        "turn_weekday": today + days(F.when(turn("turn_weekday") == "last", -before).when(turn("turn_weekday") == "next", behind).otherwise(F.pmod(behind, F.lit(7)))),
        "turn_month": _same_day(local, year + shift, named),
        "named_day": local + days(offset),
        "weekday": today - days(back),
        "month": _same_day(local, year, _month_number(phrase)),
        "year": _same_day(local, phrase, F.month(local)),
    }
    out = F.lit(None).cast("timestamp")
    for form, value in reversed(values.items()):
        out = F.when(_is(phrase, form), value).otherwise(out)
    return out


def known_zone(name: str | None) -> str:
    """The zone if there is one of that name, else UTC."""
    try:
        return str(ZoneInfo(name or "UTC"))
    except (KeyError, ValueError, OSError):
        return "UTC"


def _zone(zone: Column | str) -> Column:
    return F.lit(known_zone(zone)) if isinstance(zone, str) else zone


def phrases(text: Column) -> Column:
    """The date phrases of a text in order; of null none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE), F.lit(0))


def precision(phrase: Column) -> Column:
    """time, day, year or month, by the digits in the phrase."""
    out = F.lit("month")
    for pattern, name in reversed(PRECISIONS):
        out = F.when(F.rlike(phrase, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def dates_of(text: Column, base: Column, zone: Column | str = "UTC") -> Column:
    """Every date of a text as (text, value, precision, relative), in order: ``value`` is the instant in UTC.

    ``base`` is when the text was written (UTC), ``zone`` its user's zone; a zone's name that does not exist counts as UTC
    if it is given as a string. Phrases that name no existing day are left out; a null base leaves out all that need it.
    """
    z = _zone(zone)
    local = F.from_utc_timestamp(base, z)
    told = F.transform(
        phrases(text),
        lambda p: F.struct(p.alias("text"), F.to_utc_timestamp(local_value(p, local), z).alias("value"), precision(p).alias("precision"), F.rlike(p, F.lit(RELATIVE)).alias("relative")),
    )
    return F.filter(told, lambda d: d["value"].isNotNull())


def asked_range(question: Column, base: Column, zone: Column | str = "UTC") -> Column:
    """(phrase, start, end) in UTC of the first date in a question; null if it has no word of time or no date.

    A month by name without a day is all of it in the user's zone; anything else the UTC day of its instant.
    """
    z = _zone(zone)
    local = F.from_utc_timestamp(base, z)

    def span(d: Column) -> Column:
        value = d["value"]
        whole = F.rlike(d["phrase"], F.lit(MONTH)) & ~F.rlike(d["phrase"], F.lit(r"\b\d{1,2}\b"))
        month, day = F.trunc(value, "month"), F.date_trunc("day", F.to_utc_timestamp(value, z))
        start = F.when(whole, F.to_utc_timestamp(month.cast("timestamp"), z)).otherwise(day)
        end = F.when(whole, F.to_utc_timestamp(F.add_months(month, 1).cast("timestamp"), z)).otherwise(day + F.make_interval(days=F.lit(1)))
        return F.when(value.isNotNull(), F.struct(d["phrase"].alias("phrase"), start.alias("start"), end.alias("end")))

    # As functions over a list of one, each step is evaluated once for all that is built on it.
    asked = F.slice(F.when(F.rlike(question, F.lit(TEMPORAL)), phrases(question)), 1, 1)
    told = F.transform(asked, lambda p: F.struct(p.alias("phrase"), local_value(p, local).alias("value")))
    return F.get(F.transform(told, span), F.lit(0))
