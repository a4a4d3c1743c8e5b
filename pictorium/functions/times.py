"""Timestamps written unevenly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parsed(text: Column) -> Column:
    """A timestamp, or NULL where the text isn't one."""
    return F.try_to_timestamp(text)


def rfc3339(at: Column) -> Column:
    """UTC with microseconds and Z."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_seconds(at: Column) -> Column:
    """Seconds since 1970; a missing time counts as 0."""
    return F.coalesce(F.unix_micros(at) / 1e6, F.lit(0.0))
