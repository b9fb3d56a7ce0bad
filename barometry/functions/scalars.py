"""Scalar expressions of the session model; all are Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS, DAY_MS = 60_000, 86_400_000


def rounded(x: Column, places: int) -> Column:
    """floor(x * 10**places + 0.5) / 10**places: halves go up, also below zero."""
    return F.floor(x * F.lit(float(10**places)) + F.lit(0.5)).cast("double") / F.lit(float(10**places))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null if whole is 0."""
    return F.try_divide(F.lit(100.0) * part, whole)


def minutes_since(ts: Column, start: Column) -> Column:
    return F.floor((ts - start) / F.lit(MINUTE_MS)).cast("int")


def gap_bucket(size: Column) -> Column:
    """Size class of an absolute gap in percent."""
    return F.when(size < 0.15, "xs").when(size < 0.3, "s").when(size < 0.75, "m").when(size < 1.5, "l").otherwise("xl")


def epoch_ms(x: Column) -> Column:
    """Milliseconds from an epoch number (or its digits) in s, ms, us or ns, told apart by size; no step goes through doubles."""
    n = x.cast("long")
    exact = lambda unit: F.call_function("div", n, F.lit(unit).cast("long"))
    return F.when(n < 10**11, n * 1000).when(n < 10**14, n).when(n < 10**17, exact(1000)).otherwise(exact(1_000_000))


def finite(x: Column) -> Column:
    """The number in x, or null where there is none or it isn't finite; callers quarantine nulls."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)
