"""Times of postings as naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first and last millisecond that a time may have.
EPOCH_MS = (-62_135_596_800_000, 253_402_300_799_999)

_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_CLOCK = r"(\d{2})(?:(:?)(\d{2})(?:\%d(\d{2})(?:[.,](\d+|(?=[+-])))?)?)?"
_PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?Z?$"
_ISO = rf"(?s)^{_DATE}(?:.{_CLOCK % 11}(?:([+-]){_CLOCK % 17})?)?$"


def iso_time(c: Column) -> Column:
    """An ISO 8601 date or time as naive UTC: calendar and week dates, extended and basic, with an offset or without; anything else is null.

    Fractions of a second count to the microsecond. Of a year and a month alone no time is made. The common forms are
    cast as they are; the others are taken apart.
    """
    text = F.replace(c, F.lit("Z"), F.lit("+00:00"))
    part = lambda k: F.nullif(F.regexp_extract(text, _ISO, k), F.lit(""))
    number = lambda k: part(k).cast("int")
    n = lambda k: F.coalesce(number(k), F.lit(0))
    year, month, day = part(1), F.coalesce(part(2), part(4)), F.coalesce(part(3), part(5))
    week, weekday = F.coalesce(number(6), number(8)), F.coalesce(number(7), number(9), F.lit(1))
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")  # is always in the first week
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    of_week = F.when(week.between(1, 53) & weekday.between(1, 7) & (F.year(F.date_add(monday, 3)) == year.cast("int")), F.date_add(monday, weekday - 1))
    date = F.when(year.cast("int") >= 1, F.coalesce(F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date"), of_week))
    micros = lambda k: ((n(k) * 3600 + n(k + 2) * 60 + n(k + 3)) * F.lit(1_000_000).cast("long")) + F.coalesce(F.rpad(F.substring(part(k + 4), 1, 6), 6, "0").cast("long"), F.lit(0))
    offset = micros(16) * F.when(part(15) == "-", -1).otherwise(1)
    ok = F.regexp_like(text, F.lit(_ISO)) & (n(10) < 24) & (n(12) < 60) & (n(13) < 60) & (micros(16) < 86_400_000_000)
    rest = F.when(ok & date.isNotNull(), F.timestamp_add("MICROSECOND", micros(10) - offset, date.cast("timestamp_ntz")))
    return F.when(c.rlike(_PLAIN), F.replace(c, F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")).otherwise(rest)


def epoch_ms(c: Column) -> Column:
    """Milliseconds of the epoch as naive UTC; out of range is null."""
    return F.when(c.between(*EPOCH_MS), F.timestamp_millis(c.cast("long"))).cast("timestamp_ntz")


def naive_utc(c: Column) -> Column:
    """An instant as naive UTC, whatever the session's time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp").cast("timestamp_ntz"))
