"""Time arithmetic on zone-free timestamps (the session clock is UTC)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def micros_of(width: timedelta) -> int:
    return (width.days * 86_400 + width.seconds) * 1_000_000 + width.microseconds


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.cast("long")).cast("timestamp_ntz")


def from_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def step(width: timedelta) -> Column:
    """``width`` as an interval column."""
    return F.make_dt_interval(
        F.lit(width.days), F.lit(0), F.lit(0), F.lit(width.seconds + width.microseconds / 1e6))


def slot(ts: Column, width: timedelta) -> Column:
    """Number of the ``width``-wide slot holding ``ts``, counted from 1970."""
    w = F.lit(micros_of(width))
    m = micros(ts)
    return ((m - F.pmod(m, w)) / w).cast("long")


def floor_to(ts: Column, width: timedelta) -> Column:
    m = micros(ts)
    return from_micros(m - F.pmod(m, F.lit(micros_of(width))))


def ceil_to(ts: Column, width: timedelta) -> Column:
    m, w = micros(ts), F.lit(micros_of(width))
    return from_micros(m + F.pmod(-m, w))


def age_days(newest: Column, ts: Column) -> Column:
    return (micros(newest) - micros(ts)) / F.lit(float(DAY_MICROS))


def days_before(ts: Column, days: int) -> Column:
    return ts - step(timedelta(days=days))


def naive_utc(text: Column) -> Column:
    """ISO text, with or without a zone, to a zone-free UTC time; unreadable text gives NULL."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def arrival_key(ts: Column, row_id: Column) -> Column:
    """(ts, id) packed in one fixed-width number.

    ``min_by``/``max_by`` over a struct falls back to a sort-based aggregate; over a
    decimal it stays a hash aggregate with map-side partials.
    """
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")  # above every long
    return (micros(ts).cast("decimal(19,0)") * shift + row_id.cast("decimal(19,0)")).cast("decimal(38,0)")
