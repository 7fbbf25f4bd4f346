"""Clock conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.constants import UTC_SHIFT_MS


def local_ms(sending_time: Column) -> Column:
    """YYYYMMDDHHMMSSmmm (UTC) to milliseconds since local midnight."""
    tod = sending_time % 1_000_000_000
    return (
        F.floor(tod / 10_000_000) * 3_600_000
        + F.floor(tod / 100_000) % 100 * 60_000
        + F.floor(tod / 1_000) % 100 * 1_000
        + tod % 1_000
        + UTC_SHIFT_MS
    )


def hhmmss(ms: Column) -> Column:
    """Milliseconds since midnight as HH:MM:SS.mmm."""
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3_600_000),
        F.floor(ms / 60_000) % 60,
        F.floor(ms / 1_000) % 60,
        ms % 1_000,
    )


def day_date(day: Column) -> Column:
    return F.to_date(day.cast("string"), "yyyyMMdd")


def week_label(day: Column) -> Column:
    """Monday of the week, YYYY-MM-DD."""
    return F.date_format(F.date_trunc("week", day_date(day)), "yyyy-MM-dd")


def quarter_label(day: Column) -> Column:
    d = day_date(day)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
