"""Ticks to bars, and bars into a store: clamp, deduplicate, append what is new."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("symbol", "tf")


def resample(ticks: DataFrame, bar_ms: int, order: str = "ts") -> DataFrame:
    """symbol, ts (ms of the bar's open), open, high, low, close and volume from ticks (symbol, ts, px, qty); bars without ticks are absent."""
    bucket = (F.floor(F.col("ts") / bar_ms) * bar_ms).alias("bar")
    grouped = ticks.groupBy("symbol", bucket).agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("qty").alias("volume"))
    return grouped.withColumnRenamed("bar", "ts")


def dedupe(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "tf", "ts"), first: str | None = None) -> DataFrame:
    """One bar per key: the least by first (an arrival column), then by all other columns, as Spark has no arrival order."""
    rest = [c for c in bars.columns if c not in keys]
    order = [F.col(first)] if first else []
    w = Window.partitionBy(*keys).orderBy(*order, *(F.col(c).asc_nulls_last() for c in rest if c != first))
    return bars.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def clamp(bars: DataFrame, after: int, until: int) -> DataFrame:
    """Bars with after < ts <= until."""
    return bars.filter((F.col("ts") > after) & (F.col("ts") <= until))


def watermarks(stored: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return stored.groupBy(*keys).agg(F.max("ts").alias("last_ts"))


def unseen(bars: DataFrame, marks: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Bars after their key's watermark; appending only these makes a repeated load harmless."""
    return bars.join(marks, list(keys), "left").filter(F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).drop("last_ts")


def with_year(bars: DataFrame) -> DataFrame:
    """bars with the year (UTC) that partitions the store."""
    return bars.withColumn("year", F.year(F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int"))))


def append(bars: DataFrame, path: str, marks: DataFrame | None = None) -> None:
    """Add unseen, deduplicated bars to the store at path."""
    rows = dedupe(bars if marks is None else unseen(bars, marks))
    with_year(rows).write.mode("append").partitionBy("symbol", "tf", "year").parquet(path)


def resync(bars: DataFrame, path: str) -> None:
    """Replace the partitions that bars has rows for, and no others."""
    with_year(dedupe(bars)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "tf", "year").parquet(path)
