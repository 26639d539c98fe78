"""Dates of different precision as ranges of epoch milliseconds, in UTC."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, MONTH, DAY = r"^\d{4}$", r"^\d{4}-(0[1-9]|1[0-2])$", r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"


def instant(text: Column) -> Column:
    """Epoch milliseconds of an ISO instant or of milliseconds as digits; null for anything else."""
    return F.when(text.rlike(r"^-?\d{6,16}$"), text.try_cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(text)))


def iso(ms: Column) -> Column:
    """ISO text of epoch milliseconds, with milliseconds and Z, in a session whose time zone is UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_range(text: Column) -> Column:
    """struct<lower, upper, precision> of a year, a month, a day or an instant; null if it is none. A day beyond its month's last rolls over."""
    day = F.when(text.rlike(DAY), F.date_add(F.make_date(F.substring(text, 1, 4).cast("int"), F.substring(text, 6, 2).cast("int"), F.lit(1)), F.substring(text, 9, 2).cast("int") - 1))
    month = F.when(text.rlike(MONTH), F.make_date(F.substring(text, 1, 4).cast("int"), F.substring(text, 6, 2).cast("int"), F.lit(1)))
    year = F.when(text.rlike(YEAR), F.make_date(text.try_cast("int"), F.lit(1), F.lit(1)))
    ms = lambda d: F.unix_millis(d.cast("timestamp"))

    def of(start: Column, after: Column, precision: str) -> Column:
        return F.struct(ms(start).alias("lower"), (ms(after) - 1).alias("upper"), F.lit(precision).alias("precision"))

    exact = instant(text)
    return (
        F.when(year.isNotNull(), of(year, F.add_months(year, 12), "year"))
        .when(month.isNotNull(), of(month, F.add_months(month, 1), "month"))
        .when(day.isNotNull(), of(day, F.date_add(day, 1), "day"))
        .when(exact.isNotNull(), F.struct(exact.alias("lower"), exact.alias("upper"), F.lit("instant").alias("precision")))
    )


def intersect(a: Column, b: Column) -> Column:
    """What two ranges share, with the precision of the narrower (the first of equals); null if nothing."""
    lower, upper = F.greatest(a["lower"], b["lower"]), F.least(a["upper"], b["upper"])
    finer = F.when(b["upper"] - b["lower"] < a["upper"] - a["lower"], b["precision"]).otherwise(a["precision"])
    return F.when(lower <= upper, F.struct(lower.alias("lower"), upper.alias("upper"), finer.alias("precision")))


def coarsest(lower: Column, upper: Column) -> Column:
    """The shortest text of a range: its year, month or day if it is exactly one, an instant if it is a point, else start/end."""
    at = F.timestamp_millis(lower)
    spans = lambda unit: (F.date_trunc(unit, at) == at) & (F.unix_millis(F.date_trunc(unit, at) + F.expr(f"INTERVAL 1 {unit}")) - 1 == upper)
    return (
        F.when(spans("year"), F.date_format(at, "yyyy")).when(spans("month"), F.date_format(at, "yyyy-MM")).when(spans("day"), F.date_format(at, "yyyy-MM-dd"))
        .when(lower == upper, iso(lower)).otherwise(F.concat(iso(lower), F.lit("/"), iso(upper)))
    )


_UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration(text: str) -> int:
    """Milliseconds of 45s, 30m, 12h, 3d or 2w."""
    m = re.fullmatch(r"(\d+)([smhdw])", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def relative(word: str, now: dt.datetime) -> tuple[int, int]:
    """[first, last] millisecond of today, yesterday, this or last week (from Monday), month or year, or of -N with a unit: from so long ago until now."""
    ms = lambda t: int(t.timestamp() * 1000)
    now = now.astimezone(dt.timezone.utc)
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"-(\d+[smhdw])", word):
        return ms(now) - duration(m[1]), ms(now)
    week, month, year = day - dt.timedelta(days=day.weekday()), day.replace(day=1), day.replace(month=1, day=1)
    before = {"week": week - dt.timedelta(7), "month": (month - dt.timedelta(1)).replace(day=1), "year": year.replace(year=year.year - 1)}
    after = {"week": week + dt.timedelta(7), "month": (month + dt.timedelta(32)).replace(day=1), "year": year.replace(year=year.year + 1)}
    starts = {"week": week, "month": month, "year": year}
    if word == "today":
        return ms(day), ms(day + dt.timedelta(1)) - 1
    if word == "yesterday":
        return ms(day - dt.timedelta(1)), ms(day) - 1
    which, _, unit = word.partition(" ")
    if unit in starts and which == "this":
        return ms(starts[unit]), ms(after[unit]) - 1
    if unit in starts and which == "last":
        return ms(before[unit]), ms(starts[unit]) - 1
    raise ValueError(f"not a relative date: {word!r}")


def chrome(us: Column) -> Column:
    """Epoch milliseconds of microseconds since 1601."""
    return F.floor(us / 1000) - 11_644_473_600_000


def apple(seconds: Column) -> Column:
    """Epoch milliseconds of seconds since 2001."""
    return F.round((seconds + 978_307_200) * 1000).cast("long")


#: Shapes of an instant in UTC and of a date: open digits of a year are X, an open month or day is XX, a qualifier may end it; fixed values.
_INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z\z"
_DATE = r"^(?=\d*X*[-?~%]|\d*X*\z)[\dX]{4}(-(\d\d|XX)){0,2}[?~%]?\z"


def dated(text: Column) -> Column:
    """struct<instant boolean, first long, last long> of an instant or a date of any precision; null if the text is neither.

    first and last bound what the text can mean: of an instant both are its microseconds, of a date they count days as if
    all months had 31, from the least to the greatest year that its digits allow. Where no year is fixed, any day of a
    leap year will do.
    """
    parts = F.split(F.rtrim(text, F.lit("?~%")), "-")
    year, month, day = (F.nullif(F.get(parts, F.lit(i)), F.lit("XX")) for i in range(3))
    sample = F.concat_ws("-", F.when(year.contains("X"), "2000").otherwise(year), F.coalesce(month, F.lit("01")), F.coalesce(day, F.lit("01")))
    says = F.when(month.isNull(), day.isNull() & (year != "XXXX")).otherwise(True)
    count = lambda x, m, d: F.replace(year, F.lit("X"), F.lit(x)).try_cast("long") * 372 + F.coalesce(month.try_cast("long"), F.lit(m)) * 31 + F.coalesce(day.try_cast("long"), F.lit(d))
    date = F.struct(F.lit(False).alias("instant"), count("0", 1, 1).alias("first"), count("9", 12, 31).alias("last"))
    at = F.unix_micros(F.try_to_timestamp(text))
    return F.when(text.rlike(_INSTANT) & at.isNotNull(), F.struct(F.lit(True).alias("instant"), at.alias("first"), at.alias("last"))).when(
        text.rlike(_DATE) & says & sample.try_cast("date").isNotNull(), date
    )


def is_instant(text: Column) -> Column:
    """Whether a text is a full instant in UTC."""
    return F.when(text.isNotNull(), F.coalesce(dated(text)["instant"], F.lit(False)))


def is_date_time(text: Column) -> Column:
    """Whether a text is one instant or date that dated() knows."""
    return F.when(text.isNotNull(), dated(text).isNotNull())


def is_date_range(text: Column) -> Column:
    """Whether a text is a date, or two dates or two instants with a slash between them of which the second can be as late as the first."""
    ends = F.transform(F.split(text, "/", -1), dated)
    a, b = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    fits = F.when(F.size(ends) == 1, ~a["instant"]).when(F.size(ends) == 2, (a["instant"] == b["instant"]) & (a["first"] <= b["last"]))
    return F.when(text.isNotNull(), F.coalesce(fits, F.lit(False)))
