"""Running values over long keys: blocks of a key's rows are scanned apart, with what comes in from the blocks before or behind.

A window over a whole key puts all its rows into one task. Here a key's rows are dealt by
(key, block), each block is summed up in one row, and a window over these few rows tells what
a block's scan starts from. Blocks are ranges of the order, so the results are the same.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their keys up to each, in the order; block must not fall along it."""
    totals = rows.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    came = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, block, F.coalesce(F.sum("_sum").over(came), F.lit(0.0)).alias("_carry"))
    own = Window.partitionBy(*keys, block).orderBy(*order)
    return rows.join(carry, [*keys, block]).withColumn(name, F.col("_carry") + F.sum(value).over(own)).drop("_carry")


def next_known(rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], values: Sequence[str], inclusive: bool = False) -> DataFrame:
    """rows with next_<value>: the first value that is not null behind each row (with inclusive, from the row on) in the order of its keys; null if none follows.

    order is ascending; block must not fall along it.
    """
    backwards = [c.desc_nulls_last() for c in order]
    own = Window.partitionBy(*keys, block).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    first = lambda v: F.min(F.when(F.col(v).isNotNull(), F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), F.col(v).alias("_v"))))
    heads = rows.groupBy(*keys, block).agg(*(first(v).alias(f"_h_{v}") for v in values))
    behind = Window.partitionBy(*keys).orderBy(F.desc(block)).rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(*keys, block, *(F.last(F.col(f"_h_{v}._v"), ignorenulls=True).over(behind).alias(f"_c_{v}") for v in values))
    found = {f"next_{v}": F.coalesce(F.last(v, ignorenulls=True).over(own), F.col(f"_c_{v}")) for v in values}
    return rows.join(carry, [*keys, block]).withColumns(found).drop(*(f"_c_{v}" for v in values))


def last_before(rows: DataFrame, keys: Sequence[str], block: str, value: str) -> DataFrame:
    """rows with last_<value>: the greatest value below each row's own among its keys' rows, values being distinct; block must rise with it."""
    tops = rows.groupBy(*keys, block).agg(F.max(value).alias("_top"))
    came = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, block, F.max("_top").over(came).alias("_carry"))
    own = Window.partitionBy(*keys, block).orderBy(value)
    return rows.join(carry, [*keys, block]).withColumn(f"last_{value}", F.coalesce(F.lag(value).over(own), F.col("_carry"))).drop("_carry")


def value_blocks(rows: DataFrame, keys: Sequence[str], value: str, size: int, name: str) -> DataFrame:
    """rows with a block number by ranges of a value from 0 up, of about size rows each where values are spread evenly."""
    spans = rows.groupBy(*keys).agg(F.max(value).alias("_top"), F.count("*").alias("_n"))
    number = F.floor(F.col(value) / F.greatest(F.col("_top"), F.lit(1e-300)) * F.ceil(F.col("_n") / size)).cast("long")
    return rows.join(spans, list(keys)).withColumn(name, number).drop("_top", "_n")
