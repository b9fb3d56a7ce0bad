"""Bars from the events table: each event moves its type's price by some cents."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS
from ..operators.ingest import resample

BAR_MS = 900_000
#: The contract changes here (2024-01-16 UTC).
ROLL_MS = 1_705_363_200_000


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (ms) and px of every event.

    The running sum goes day by day: days are summed first, so no symbol's history has to fit
    into one task.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts) div 1000")
    step = F.expr("(case when event_id % 2 = 0 then 1 else -1 end) * (cast(round(value * 100) as bigint) div 5)")
    moves = events.select(F.col("event_type").alias("symbol"), ms.alias("ts"), F.col("ts").alias("at"), step.alias("step")).withColumn("day", F.floor(F.col("ts") / DAY_MS))
    days = moves.groupBy("symbol", "day").agg(F.sum("step").alias("moved"))
    before = days.select("symbol", "day", F.coalesce(F.sum("moved").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("step").over(Window.partitionBy("symbol", "day").orderBy("at"))
    return moves.withColumn("within", within).join(before, ["symbol", "day"]).select("symbol", "ts", "at", ((F.lit(1000000) + F.col("before") + F.col("within")).cast("double") / 100.0).alias("px"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars of every event type, with a contract that rolls once."""
    made = resample(ticks(spark, sf_dir).withColumn("qty", F.lit(1.0)), BAR_MS, order="at")
    return made.withColumn("contract", F.when(F.col("ts") < ROLL_MS, "F4").otherwise("G4"))
