"""Date and time expressions.

Order times are naive wall-clock times, as in the source exports. They are kept as
``TIMESTAMP_NTZ`` so that results never depend on the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

SECONDS_PER_DAY = 86400


def to_naive_ts(c) -> Column:
    """Parse a date string (or cast a timestamp) to a naive timestamp truncated to seconds."""
    c = as_col(c)
    return F.date_trunc("second", F.to_timestamp_ntz(c.cast("string"))).cast("timestamp_ntz")


def epoch_seconds(c) -> Column:
    """Whole seconds since 1970-01-01 of a naive timestamp (bigint, time-zone free)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            as_col(c).cast("timestamp_ntz"))


def whole_days(seconds: Column) -> Column:
    """Whole days of a non-negative span in seconds (floor, not a calendar difference)."""
    return F.floor(seconds / F.lit(SECONDS_PER_DAY)).cast("bigint")


def order_time_parts(ts) -> dict[str, Column]:
    """Day, month, year, ``HH:MM:SS`` text, hour and minute of an order time."""
    ts = as_col(ts)
    return {
        "order_day": F.dayofmonth(ts),
        "order_month": F.month(ts),
        "order_year": F.year(ts),
        "order_time": F.date_format(ts, "HH:mm:ss"),
        "order_hour": F.hour(ts),
        "order_minute": F.minute(ts),
    }


def rebuild_datetime(year, month, day, hhmmss) -> Column:
    """Rebuild the order time from its parts."""
    txt = F.concat_ws("-", as_col(year).cast("string"), F.lpad(as_col(month).cast("string"), 2, "0"),
                      F.lpad(as_col(day).cast("string"), 2, "0"))
    return F.to_timestamp_ntz(F.concat(txt, F.lit(" "), as_col(hhmmss)))


def cyclical(c, period: float) -> tuple[Column, Column]:
    """sin and cos of ``2*pi*x/period``."""
    ang = F.lit(2 * math.pi) * as_col(c).cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


# Periods of the cyclic encodings.
CYCLIC_PERIODS = {"order_day": 31, "order_month": 12, "order_hour": 24, "order_minute": 60}


def add_cyclical(df, periods: dict | None = None):
    """Add ``{col}_sin`` / ``{col}_cos`` for each column in ``periods``."""
    periods = periods or CYCLIC_PERIODS
    cols = {}
    for name, p in periods.items():
        s, c = cyclical(name, p)
        cols[f"{name}_sin"] = s
        cols[f"{name}_cos"] = c
    return df.withColumns(cols)
