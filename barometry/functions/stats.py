"""Binomial statistics as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import rounded

Z = 1.959963984540054
WARN, REFUSE, RECENT = 30, 10, 250


def wilson(n: Column, k: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval of k successes in n; null without trials, an error if k is outside 0 to n."""
    k = F.when((n > 0) & ((k < 0) | (k > n)), F.raise_error(F.lit("successes must be from 0 to the number of trials"))).otherwise(k)
    m, p = n.cast("double"), F.try_divide(k.cast("double"), n.cast("double"))
    below = 1.0 + Z * Z / m
    centre = p + Z * Z / (2.0 * m)
    wide = Z * F.sqrt(p * (1.0 - p) / m + Z * Z / (4.0 * m * m))
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), (centre - wide) / below)), F.when(some, F.least(F.lit(1.0), (centre + wide) / below))


def estimate(n: str, k: str, prefix: str = "", places: int = 4) -> list[Column]:
    """Columns estimate, ci_low and ci_high of counts, rounded; null without trials."""
    low, high = wilson(F.col(n), F.col(k))
    p = F.when(F.col(n) > 0, F.try_divide(F.col(k).cast("double"), F.col(n).cast("double")))
    return [rounded(x, places).alias(f"{prefix}{name}") for x, name in ((p, "estimate"), (low, "ci_low"), (high, "ci_high"))]
