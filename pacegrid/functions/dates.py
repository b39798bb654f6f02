"""Date helpers.  Every date-relative operator takes an explicit ``as_of``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(d) -> Column:
    """A literal DATE from ``'YYYY-MM-DD'``, a ``date`` or a Column."""
    if isinstance(d, Column):
        return d.cast("date")
    if isinstance(d, _dt.date):
        d = d.isoformat()
    return F.lit(d).cast("date")


def week_start(d: Column) -> Column:
    """Monday of the week (Python ``d - timedelta(d.weekday())``)."""
    return F.date_trunc("week", d).cast("date")


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def day_label(d: Column) -> Column:
    """``strftime('%d %b')`` in the C locale, e.g. ``05 Jan``."""
    return F.date_format(d, "dd MMM")
