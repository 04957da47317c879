"""Time expressions on TIMESTAMP_NTZ. None depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FULL_WIDTH = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"
_TEXT_TIME = r"^\s*(\d{1,2})/(\d{1,2})/(\d{1,4})\s+(\d{1,2}:\d{1,2}:\d{1,2})\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_day_first(text: Column | str) -> Column:
    """``d/M/y H:m:s`` text to TIMESTAMP_NTZ; anything else, or an impossible date, is NULL.

    Texts of the usual full width are cut by position, others are rewritten to
    ISO order; both are then cast. Every use of the text is one short call, so
    the generated code stays small enough for the JIT.
    """
    text = _col(text)
    iso = F.concat(
        F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2),
        F.substring(text, 11, 9),
    )
    # Short years are padded: two digits are a year of the first century, as four digits with zeros are.
    padded = F.regexp_replace(text, r"/(\d)\s", "/0$1 ")
    reordered = F.regexp_replace(padded, _TEXT_TIME, "00$3-$2-$1 $4")
    loose = F.when(text.rlike(_TEXT_TIME), reordered)
    return F.when(text.rlike(_FULL_WIDTH), iso).otherwise(loose).try_cast("timestamp_ntz")


def parse_date(text: Column | str) -> Column:
    """``d/M/y`` or ISO text, with or without a time, to a date; anything else is NULL."""
    text = F.trim(_col(text))
    day_first = F.regexp_replace(F.substring_index(text, " ", 1), r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    return F.when(text.rlike(r"^\d{1,2}/"), day_first).otherwise(F.substring_index(text, " ", 1)).try_cast("date")


def parse_time(text: Column | str) -> Column:
    """``d/M/y H:m:s`` or ISO text to a time; anything else is NULL."""
    text = _col(text)
    return F.coalesce(parse_day_first(text), F.trim(text).try_cast("timestamp_ntz"))


def day_first(iso: Column | str) -> Column:
    """ISO text of a time to ``dd/MM/yyyy HH:mm:ss`` text. Give a column: every use of an expression may compute it again."""
    iso = _col(iso)
    return F.concat(
        F.substring(iso, 9, 2), F.lit("/"), F.substring(iso, 6, 2), F.lit("/"), F.substring(iso, 1, 4),
        F.lit(" "), F.substring(iso, 12, 8),
    )


def format_day_first(ts: Column | str) -> Column:
    """TIMESTAMP_NTZ to ``dd/MM/yyyy HH:mm:ss`` text."""
    return day_first(_col(ts).cast("string"))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed from start to end, as bigint."""
    return F.date_diff(_col(end), _col(start)).cast("bigint")


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Full-hour marks crossed from start to end, as bigint."""
    start, end = _col(start), _col(end)
    return days_between(start, end) * 24 + (F.hour(end) - F.hour(start)).cast("bigint")


def add_years(ts: Column | str, years: int) -> Column:
    return _col(ts) + F.make_ym_interval(F.lit(years))


def month_start(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "MM").cast("timestamp_ntz")


def weekday_sunday0(ts: Column | str) -> Column:
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")
