"""Column expressions on numbers and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(value: Column, base: Column) -> Column:
    """``value / base`` as double, where a base of 0 or null counts as 1."""
    return value.cast("double") / F.coalesce(F.nullif(base.cast("double"), F.lit(0.0)), F.lit(1.0))


def mean_of(total: Column, count: Column, digits: int | None = None) -> Column:
    """``total / count`` as double, 0 when the count is 0."""
    mean = F.coalesce(F.try_divide(total.cast("double"), count.cast("double")), F.lit(0.0))
    return mean if digits is None else F.round(mean, digits)


def damping(name: Column) -> Column:
    """Weight factor of an identifier: private names (leading underscore) count a tenth."""
    return F.when(F.startswith(name, F.lit("_")), F.lit(0.1)).otherwise(F.lit(1.0))


def _day(as_of: dt.date | str) -> Column:
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else F.to_date(F.lit(as_of))


def _has_time(as_of: dt.date | str) -> bool:
    return ":" in as_of if isinstance(as_of, str) else isinstance(as_of, dt.datetime)


def window_start(as_of: dt.date | str, months: int) -> Column:
    return F.add_months(_day(as_of), -months)


def in_window(ts: Column, as_of: dt.date | str, months: int) -> Column:
    """True from the day ``months`` calendar months before ``as_of`` up to ``as_of``: an instant, or the end of a bare date."""
    start = window_start(as_of, months).cast("timestamp_ntz")
    if _has_time(as_of):
        return ts.between(start, F.lit(as_of).cast("timestamp_ntz"))
    last = F.date_add(_day(as_of), 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")
    return ts.between(start, last)


def period_label(as_of: dt.date | str, months: int) -> Column:
    """``YYYY-MM-DD to YYYY-MM-DD``."""
    day = "yyyy-MM-dd"
    return F.concat(
        F.date_format(window_start(as_of, months), day), F.lit(" to "), F.date_format(_day(as_of), day)
    )
