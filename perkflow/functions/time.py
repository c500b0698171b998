"""Event-time helpers: literals, interval bounds, window predicates.

Batch tables keep naive ``TIMESTAMP_NTZ`` wall times; streams need instants
(``TimestampType``) for watermarks. Wall times are read as UTC instants, so
tumbling windows align to UTC midnight either way.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkflow import config

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def duration_seconds(duration: str | int) -> int:
    """'5 minutes' -> 300; an int is taken as seconds."""
    if isinstance(duration, int):
        return duration
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]+?)s?\s*", duration)
    if not m or m.group(2).lower() not in _UNITS:
        raise ValueError(f"unsupported duration: {duration!r}")
    return int(m.group(1)) * _UNITS[m.group(2).lower()]


def seconds_duration(seconds: int) -> str:
    return f"{int(seconds)} seconds"


def to_datetime(value: str | dt.datetime | dt.date) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def to_date(value: str | dt.datetime | dt.date) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.fromisoformat(value).date()


def ts_lit(value: str | dt.datetime) -> Column:
    """Naive timestamp literal (TIMESTAMP_NTZ); folded by Catalyst."""
    return F.lit(to_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: str | dt.date) -> Column:
    return F.lit(to_date(value).isoformat()).cast("date")


def ntz_to_instant(c: Column) -> Column:
    """Wall time (NTZ) -> instant, reading the wall time as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")


def instant_to_ntz(c: Column) -> Column:
    """Instant -> UTC wall time (NTZ)."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def interval_bounds(as_of: str | dt.datetime,
                    interval_seconds: int = config.DEFAULT_INTERVAL_SECONDS):
    """Current and previous epoch-aligned interval around ``as_of``.

    Returns (current_start, current_end, previous_start, previous_end) as naive
    datetimes; the wall clock of the reference becomes the ``as_of`` argument.
    """
    t = to_datetime(as_of)
    epoch = calendar.timegm(t.timetuple())
    start_epoch = (epoch // interval_seconds) * interval_seconds
    cur_start = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=start_epoch)
    step = dt.timedelta(seconds=interval_seconds)
    return cur_start, cur_start + step, cur_start - step, cur_start


def interval_start_col(ts: Column, interval_seconds: int) -> Column:
    """Column form of the interval start: the tumbling window holding ``ts``."""
    return F.window(ts, seconds_duration(interval_seconds)).start


def interval_label(start: Column | str = "window_start",
                   end: Column | str = "window_end") -> Column:
    """'HH:mm:ss - HH:mm:ss' display label of a window."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.concat_ws(" - ", F.date_format(s, "HH:mm:ss"), F.date_format(e, "HH:mm:ss"))


def window_in_interval(start, end) -> Column:
    """Containment (not overlap): window_start >= start AND window_end <= end."""
    return (F.col("window_start") >= ts_lit(start)) & (F.col("window_end") <= ts_lit(end))


def window_before(bound) -> Column:
    """window_end strictly before ``bound``."""
    return F.col("window_end") < ts_lit(bound)


def time_filter(kind: str, as_of) -> Column:
    """Dashboard time selector as a predicate on ``window_end``.

    Today: window_end > midnight of as_of; Last Hour / Last 5 Minutes:
    window_end > as_of - span; All Time: true.
    """
    t = to_datetime(as_of)
    if kind == "All Time":
        return F.lit(True)
    if kind == "Today":
        lower = dt.datetime(t.year, t.month, t.day)
    elif kind == "Last Hour":
        lower = t - dt.timedelta(hours=1)
    elif kind == "Last 5 Minutes":
        lower = t - dt.timedelta(minutes=5)
    else:
        raise ValueError(f"unknown time filter {kind!r}; expected one of {config.TIME_FILTERS}")
    return F.col("window_end") > ts_lit(lower)


def time_filter_lower_bound(kind: str, as_of) -> dt.datetime | None:
    """The strict lower bound on window_end that ``time_filter`` applies."""
    t = to_datetime(as_of)
    return {
        "All Time": None,
        "Today": dt.datetime(t.year, t.month, t.day),
        "Last Hour": t - dt.timedelta(hours=1),
        "Last 5 Minutes": t - dt.timedelta(minutes=5),
    }[kind]
