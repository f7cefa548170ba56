"""Dates from many spellings, trading days and time windows, as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"


def _month_number(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    names = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    out = F.when(short == names[0], 1)
    for i, n in enumerate(names[1:], 2):
        out = out.when(short == n, i)
    return out


def _number(text: Column) -> Column:
    return F.try_to_number(F.nullif(text, F.lit("")), F.lit("9999")).cast("int")


def _make(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def normalize_date(text: Column, as_of: date) -> Column:
    """A date, or null: ISO; `Qn YYYY` (the quarter's first day); `Month D, YYYY`, `D Month YYYY`
    and `M/D/YYYY`; `Month D`, in the next year if it is past by then; today, tomorrow, yesterday
    and `in n days` from as_of.  Days may have ordinals (15th).  n/a, tbd and the like are null."""
    t = F.trim(text)
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    quarter = r"(?i)\bq([1-4])[\s-]*(\d{4})\b"
    of_quarter = _make(_number(F.regexp_extract(t, quarter, 2)), (_number(F.regexp_extract(t, quarter, 1)) - 1) * 3 + 1, F.lit(1))
    full = rf"(?i)\b({_MONTHS})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*|\s+)(\d{{4}})\b"
    of_day = _make(_number(F.regexp_extract(t, full, 3)), _month_number(F.regexp_extract(t, full, 1)), _number(F.regexp_extract(t, full, 2)))
    turned = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTHS})\.?,?\s+(\d{{4}})\b"
    day_first = _make(_number(F.regexp_extract(t, turned, 3)), _month_number(F.regexp_extract(t, turned, 2)), _number(F.regexp_extract(t, turned, 1)))
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    by_slash = _make(_number(F.regexp_extract(t, slashed, 3)), _number(F.regexp_extract(t, slashed, 1)), _number(F.regexp_extract(t, slashed, 2)))
    away = F.when(F.lower(t) == "today", 0).when(F.lower(t) == "tomorrow", 1).when(F.lower(t) == "yesterday", -1).otherwise(_number(F.regexp_extract(t, r"(?i)^in (\d{1,4}) days?$", 1)))
    relative = F.date_add(F.lit(as_of), away)
    short = rf"(?i)^({_MONTHS})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?$"
    this_year = _make(F.lit(as_of.year), _month_number(F.regexp_extract(t, short, 1)), _number(F.regexp_extract(t, short, 2)))
    rolled = F.when(this_year < F.lit(as_of), F.add_months(this_year, 12)).otherwise(this_year)
    empty = F.lower(t).isin("", "null", "none", "n/a", "na", "tbd", "tba", "unknown")
    return F.when(~empty, F.coalesce(iso, of_quarter, of_day, day_first, by_slash, rolled, relative))


#: Fixed value: days that a calendar's window may span.
MOST_DAYS = 400


def month_bounds(day: Column) -> tuple[Column, Column]:
    """The first and the last day of a date's month: a calendar's window where none is asked for."""
    return F.trunc(day, "month"), F.last_day(day)


def checked_window(first: date, last: date) -> tuple[date, date]:
    """The window, if it is one; else an error that says why."""
    if first > last:
        raise ValueError("the window's first day is after its last")
    if (last - first).days > MOST_DAYS:
        raise ValueError(f"the window spans more than {MOST_DAYS} days")
    return first, last


def next_trading_day(day: Column) -> Column:
    """The following weekday."""
    weekday = F.dayofweek(day)  # 1 is Sunday
    return F.date_add(day, F.when(weekday == 6, 3).when(weekday == 7, 2).otherwise(1))


def end_of_day(day: Column) -> Column:
    """The last second of a date: when a filing of that day is known."""
    return day.cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")


def horizon_days(horizon: Column) -> Column:
    return F.when(horizon == "short", 7).when(horizon == "medium", 14).otherwise(30)


def parse_timestamp(text: Column, *formats: str) -> Column:
    """The first format that fits; epoch seconds are taken too."""
    epoch = F.when(text.rlike(r"^\d{9,10}$"), F.timestamp_seconds(text.try_cast("long")))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats), epoch)
