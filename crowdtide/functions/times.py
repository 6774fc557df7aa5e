"""Time functions on columns; clock times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_to_timestamp(seconds: Column) -> Column:
    """Seconds since 1970 (fractions kept) to a timestamp without zone."""
    exact = F.round(seconds.cast("double"), 6).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, exact)


def timestamp_to_epoch(moment: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), moment)


def parse_date(text: Column) -> Column:
    """``YYYY-MM-DD`` to seconds since 1970, the day's start in UTC."""
    return (F.unix_date(F.to_date(text, "yyyy-MM-dd")) * F.lit(86400)).cast("long")
