"""Time helpers. Instants travel as microseconds since 1970 (long), which sorts,
subtracts and hashes without time-zone rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(c: Column | str) -> Column:
    """Timestamp (with or without zone) or date to microseconds; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column | str) -> Column:
    """Microseconds back to a timestamp without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros(c).cast("timestamp_ntz")


def second_text(c: Column | str) -> Column:
    """Timestamp to `yyyy-MM-dd HH:mm:ss`."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def day_text(c: Column | str) -> Column:
    """Timestamp or date to `yyyy-MM-dd`."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")
