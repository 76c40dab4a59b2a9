"""Dates: parsing as column expressions, and date expressions found in text."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.udf import arrow_udf

MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m} | {"sept": 9}
WEEKDAYS = {d.lower(): i for i, d in enumerate(calendar.day_name)}
_M = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1, "few": 3, "couple": 2}


def parse_timestamp(value: Column) -> Column:
    """ISO, Y-m-d, Y/m/d and Y-m-d H:M:S, without a zone taken as UTC; null for the rest."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_in_month(value: Column) -> Column:
    return F.day(F.last_day(value))


def month_window(value: Column) -> Column:
    return F.struct(F.trunc(value, "month").alias("first"), F.last_day(value).alias("last"))


def easter(year: int) -> date:
    """The Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return date(year, f // 31, f % 31 + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year, month, calendar.monthrange(year, month)[1])
    return last - timedelta((last.weekday() - weekday) % 7)


_FIXED = {"valentine's day": (2, 14), "labour day": (5, 1), "independence day": (7, 4), "halloween": (10, 31), "christmas eve": (12, 24), "christmas": (12, 25), "boxing day": (12, 26), "new year's eve": (12, 31), "new years": (1, 1), "new year's day": (1, 1)}
_NTH = {"thanksgiving": (11, 3, 4), "memorial day": (5, 0, -1), "labor day": (9, 0, 1), "mother's day": (5, 6, 2), "father's day": (6, 6, 3), "martin luther king day": (1, 0, 3)}


def holiday(name: str, year: int) -> date | None:
    n = name.lower().strip().replace("’", "'")
    if n in _FIXED:
        return date(year, *_FIXED[n])
    if n in _NTH:
        month, weekday, k = _NTH[n]
        return nth_weekday(year, month, weekday, k)
    shift = {"easter": 0, "easter sunday": 0, "good friday": -2, "easter monday": 1, "pentecost": 49}.get(n)
    return None if shift is None else easter(year) + timedelta(shift)


def _add_months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def _valid(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


_Y, _2, _DAY = r"(\d{4})", r"(\d{2})", r"(\d{1,2})"
_TH = r"(?:th|st|nd|rd)?"


def _on(order: str):
    """A resolver that reads year, month and day from the groups named by the letters of `order`."""

    def resolve(m, now: date):
        part = dict(zip(order, m.groups()))
        month = part.get("m", "1")
        month = int(month) if month.isdigit() else MONTHS[month.lower()]
        grain = "day" if "d" in part else "month" if "m" in part else "year"
        return _valid(int(part.get("y", now.year)), month, int(part.get("d", 1))), grain

    return resolve


_ABSOLUTE = tuple(
    (re.compile(rf"\b{regex}", re.I), _on(order))
    for order, regex in (
        ("ymd", rf"{_Y}-{_2}-{_2}\b"),
        ("ymd", rf"{_Y}/{_DAY}/{_DAY}\b"),
        ("mdy", rf"{_M} {_DAY}{_TH},? {_Y}\b"),
        ("dmy", rf"{_DAY}{_TH} (?:of )?{_M},? {_Y}\b"),
        ("my", rf"{_M},? {_Y}\b"),
        ("md", rf"{_M} {_DAY}{_TH}\b"),
        ("ym", rf"{_Y}-{_2}\b(?!-)"),
        ("y", r"(?:in|since|until|during|of) ((?:19|20)\d{2})\b"),
    )
)


def _count(word: str) -> int:
    return int(word) if word.isdigit() else NUMBERS[word]


def _ago(m, now: date, sign: int):
    n, unit = _count(m[1].lower()), m[2].lower()
    if unit == "day":
        return now + timedelta(sign * n), "day"
    if unit == "week":
        return now + timedelta(sign * 7 * n), "day"
    if unit == "month":
        return _add_months(now, sign * n), "month"
    return _add_months(now, sign * 12 * n), "year"


def _weekday(m, now: date, direction: int):
    w = WEEKDAYS[m[1].lower()]
    gap = (now.weekday() - w) % 7 or 7
    return (now - timedelta(gap) if direction < 0 else now + timedelta((w - now.weekday()) % 7 or 7)), "day"


_N = r"(\d+|" + "|".join(NUMBERS) + r")(?: of)?"
_D = "(" + "|".join(WEEKDAYS) + ")"
_NEAR = {"day before yesterday": -2, "yesterday": -1, "today": 0, "tomorrow": 1}
_RELATIVE = (
    (re.compile(r"\b(day before yesterday|yesterday|today|tomorrow)\b", re.I), lambda m, now: (now + timedelta(_NEAR[m[1].lower()]), "day")),
    (re.compile(rf"\b(?:a )?{_N} (day|week|month|year)s? ago\b", re.I), lambda m, now: _ago(m, now, -1)),
    (re.compile(rf"\bin (?:a )?{_N} (day|week|month|year)s?\b", re.I), lambda m, now: _ago(m, now, 1)),
    (re.compile(r"\blast week\b", re.I), lambda m, now: (now - timedelta(7), "week")),
    (re.compile(r"\blast month\b", re.I), lambda m, now: (_add_months(now.replace(day=1), -1), "month")),
    (re.compile(r"\blast year\b", re.I), lambda m, now: (date(now.year - 1, 1, 1), "year")),
    (re.compile(r"\bnext month\b", re.I), lambda m, now: (_add_months(now.replace(day=1), 1), "month")),
    (re.compile(rf"\blast {_D}\b", re.I), lambda m, now: _weekday(m, now, -1)),
    (re.compile(rf"\bnext {_D}\b", re.I), lambda m, now: _weekday(m, now, 1)),
)


def find_dates(text: str, now: date | datetime) -> list[tuple[int, int, str, str, str]]:
    """(start, end, ISO date, surface, granularity) of every date expression, earliest patterns first, without overlaps."""
    today = now.date() if isinstance(now, datetime) else now
    taken: list[tuple[int, int]] = []
    out = []
    for pattern, resolve in (*_ABSOLUTE, *_RELATIVE):
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            found, granularity = resolve(m, today)
            if found is not None:
                taken.append(m.span())
                out.append((m.start(), m.end(), found.isoformat(), m[0], granularity))
    return sorted(out)


def first_date(text: str, now: date | datetime) -> str | None:
    found = find_dates(text, now)
    return found[0][2] if found else None


@arrow_udf("array<struct<start:int,end:int,iso:string,surface:string,granularity:string>>")
def dates_in(texts: pd.Series, now: pd.Series) -> pd.Series:
    names = ("start", "end", "iso", "surface", "granularity")
    return pd.Series([[dict(zip(names, d)) for d in find_dates(t or "", n)] for t, n in zip(texts, now)])
