"""Timestamp text to instants, without rewriting the text.

Accepted: ISO-8601 with an offset, in calendar or week form, extended or basic.
The result is microseconds since the epoch (LONG), so it does not depend on the
session time zone. NULL means the text has no instant.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from tenetlog.functions.canonical import rarely

_COMMON = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-](0\d|1[0-7]):[0-5]\d)$"
_DATE = r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?))"
_TIME = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d*))?)?)?"
_OFFSET = r"(?:(Z)|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?)"
_FULL = "^" + _DATE + r"[\s\S]" + _TIME + _OFFSET + "$"
# Basic and extended spellings may not be mixed inside one time or one offset.
_PART = r"(?:\d{2}|\d{2}:\d{2}|\d{4}|\d{2}:\d{2}:\d{2}(?:[.,]\d*)?|\d{6}(?:[.,]\d*)?)"
_SHAPE = r"^[0-9W-]{7,10}[\s\S]" + _PART + r"(?:Z|[+-]" + _PART + ")$"


def _group(text: Column, index: int) -> Column:
    return F.regexp_extract(text, _FULL, index)


def _number(text: Column, index: int, default: int = 0) -> Column:
    part = _group(text, index)
    return F.when(part == "", F.lit(default)).otherwise(part.try_cast("int"))


def _general(text: Column) -> Column:
    week_year = _number(text, 7, -1)
    year = F.when(week_year >= 0, week_year).otherwise(
        F.when(_group(text, 1) != "", _number(text, 1)).otherwise(_number(text, 4)))
    month = F.when(_group(text, 1) != "", _number(text, 2)).otherwise(_number(text, 5))
    day = F.when(_group(text, 1) != "", _number(text, 3)).otherwise(_number(text, 6))
    calendar = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"),
                           F.lpad(month.cast("string"), 2, "0"),
                           F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    # Week 1 holds January 4th; weeks start on Monday.
    week = F.when(_group(text, 8) != "", _number(text, 8)).otherwise(_number(text, 10))
    weekday = F.when(_group(text, 8) != "", _number(text, 9, 1)).otherwise(_number(text, 11, 1))
    jan4 = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")).try_cast("date")
    first_monday = F.date_sub(jan4, F.weekday(jan4))
    week_date = F.date_add(first_monday, (week - 1) * 7 + weekday - 1)
    next_jan4 = F.concat(F.lpad((year + 1).cast("string"), 4, "0"), F.lit("-01-04")).try_cast("date")
    week_ok = (week >= 1) & (F.date_add(first_monday, (week - 1) * 7)
                             < F.date_sub(next_jan4, F.weekday(next_jan4)))
    date = F.when(week_year >= 0, F.when(week_ok, week_date)).otherwise(calendar)
    hour, minute, second = _number(text, 12), _number(text, 13), _number(text, 14)
    micros = F.rpad(F.substring(_group(text, 15), 1, 6), 6, "0").try_cast("int")
    off_hour, off_minute, off_second = _number(text, 18), _number(text, 19), _number(text, 20)
    off_micros = F.rpad(F.substring(_group(text, 21), 1, 6), 6, "0").try_cast("int")
    off_whole = off_hour * 3600 + off_minute * 60 + off_second
    # A fraction on a zero offset is ignored, as in Python.
    offset = off_whole.cast("long") * 1_000_000 + F.when(off_whole == 0, 0).otherwise(off_micros)
    signed = F.when(_group(text, 17) == "-", -offset).otherwise(offset)
    valid = (text.rlike(_SHAPE) & text.rlike(_FULL) & (hour < 24) & (minute < 60) & (second < 60)
             & (off_minute < 60) & (off_second < 60) & (offset < 86_400_000_000) & (year >= 1))
    clock = (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + micros
    return F.when(valid, F.unix_date(date).cast("long") * 86_400_000_000 + clock - signed)


def instant_us(text: Column) -> Column:
    """Microseconds since the epoch, or NULL. The common spelling takes a short path."""
    fast = F.unix_micros(text.try_cast("timestamp"))
    return F.when(text.rlike(_COMMON), fast).otherwise(rarely(text, _general))


def timestamp_problem(text: Column, field: str) -> Column:
    """NULL when the text names an instant, else the reason."""
    lacks_offset = (instant_us(F.concat(text, F.lit("Z"))).isNotNull()
                    | instant_us(F.concat(text, F.lit("T00Z"))).isNotNull())
    return (F.when(text.isNull(), f"{field} must be an ISO8601 string")
            .when(instant_us(text).isNotNull(), F.lit(None).cast("string"))
            .when(lacks_offset, f"{field} must carry a timezone offset")
            .otherwise(f"{field} not ISO8601"))


def literal_us(text: str, field: str = "as_of") -> int:
    """Instant of a query parameter; a text without one is refused."""
    parsed = datetime.fromisoformat(text)
    if parsed.tzinfo is None:
        raise ValueError(f"{field} {text!r} has no timezone offset")
    return (parsed - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
