"""Calendar spines and date arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from crewgrid.functions.numeric import col


def as_date(d):
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)


def month_end(y, m):
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return dt.date(ny, nm, 1) - dt.timedelta(days=1)


def month_ends(start, end):
    """Month ends from start's month through end's month, both included."""
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [month_end(i // 12, i % 12 + 1) for i in range(first, last + 1)]


def quarter_ends(as_of, n=8):
    """The n latest complete quarter ends before as_of's own quarter, oldest first."""
    q = as_of.year * 4 + (as_of.month - 1) // 3
    return [month_end((q - k) // 4, (q - k) % 4 * 3 + 3) for k in range(n, 0, -1)]


def trailing_year(as_of):
    """(first day of the month 11 months back, as_of)."""
    i = as_of.year * 12 + as_of.month - 1 - 11
    return dt.date(i // 12, i % 12 + 1, 1), as_of


def whole_months(a, b):
    """Whole months from a to b, never below zero."""
    a, b = col(a), col(b)
    m = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.greatest(F.lit(0), m - F.when(F.day(b) < F.day(a), 1).otherwise(0))


def fiscal_year_of(d, mmdd="12-31"):
    """Fiscal year holding a date when the year closes on MM-DD."""
    mm, dd = (int(x) for x in mmdd.split("-"))
    d = col(d)
    return F.when(d <= F.make_date(F.year(d), F.lit(mm), F.lit(dd)), F.year(d)).otherwise(F.year(d) + 1)


def fiscal_year_end(fy, mmdd="12-31"):
    mm, dd = (int(x) for x in mmdd.split("-"))
    return F.make_date(col(fy), F.lit(mm), F.lit(dd))


def quarter_label(d):
    d = col(d).cast("date")
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit("·"), F.date_format(d, "yy"))


def hours_between(start, end):
    """Hours between two zone-less timestamps."""
    s, e = col(start).cast("timestamp"), col(end).cast("timestamp")
    return (F.unix_micros(e) - F.unix_micros(s)) / 3.6e9
