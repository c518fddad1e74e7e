"""Nanoseconds since 1970, kept as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "Europe/Berlin"


def div(a: Column, b: int) -> Column:
    """Whole-number quotient, towards zero."""
    return F.call_function("div", a, F.lit(b))


def minute_of_day(ns: Column) -> Column:
    """UTC hour times 60 plus minute."""
    return div(F.pmod(ns, F.lit(86_400_000_000_000)), 60_000_000_000).cast("int")


def millis(ns: Column) -> Column:
    return div(ns, 1_000_000)


def timestamp(ns: Column) -> Column:
    return F.timestamp_micros(div(ns, 1000))


def local_hhmm(ns: Column, zone: str = LOCAL) -> Column:
    """Local `HH:MM`; the session's time zone is UTC."""
    return F.date_format(F.from_utc_timestamp(timestamp(ns), zone), "HH:mm")


def duration(ms: Column) -> Column:
    """Signed `h:mm:ss` of milliseconds; below one hour `m:ss`."""
    s = div(F.abs(ms), 1000)
    h, m = div(s, 3600), div(s % 3600, 60)
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60)))
