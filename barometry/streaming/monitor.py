"""Bars from streams, and the folders that batches write.

Every sink writes the folder of its batch and replaces it if the batch runs again, and reads
those of earlier batches only, so a batch that is repeated after a failure leaves nothing twice.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import derive, ingest
from ..operators.calendars import assign
from ..sources import bridge
from ..sources.store import shared_folder

DISCLAIMER = "Past frequency, not advice."


def stream_ticks(spark: SparkSession, path: str, schema) -> DataFrame:
    """Ticks from files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_bars(ticks: DataFrame, bar: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling bars from ticks (symbol, at timestamp, px, qty); a bar is final once the watermark has passed it. Of ticks of one time, the lowest opens and the highest closes."""
    own = ticks.withWatermark("at", late).groupBy("symbol", F.window("at", bar).alias("w"))
    made = own.agg(F.min(F.struct("at", "px")).alias("first"), F.max("px").alias("high"), F.min("px").alias("low"), F.max(F.struct("at", "px")).alias("last"), F.sum("qty").alias("volume"))
    return made.select("symbol", F.unix_millis("w.start").alias("ts"), F.col("first.px").alias("open"), "high", "low", F.col("last.px").alias("close"), "volume")


def stream_dedupe(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of bars without repeats of (symbol, tf, ts) that come within late of each other; state is kept that long."""
    return bars.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["symbol", "tf", "ts"]).drop("at")


def before(spark: SparkSession, path: str, batch: int, schema: T.StructType) -> DataFrame:
    """The rows that batches before this one wrote to path; none if there is nothing yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(path).filter(F.col("batch") < batch).drop("batch")


def put(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Hand all that the source has to each, batch by batch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def append_unseen(batch: DataFrame, n: int, path: str, keys: Sequence[str] = ("symbol", "tf", "source")) -> DataFrame:
    """Add a batch's bars to the store at path: one per (symbol, tf, ts), and only those after the last stored bar of their own series, so a series that lags behind others loses nothing. Returns what was added."""
    old = before(batch.sparkSession, path, n, batch.schema)
    put(ingest.unseen(ingest.dedupe(batch), ingest.watermarks(old, tuple(keys)), tuple(keys)), path, n)
    return batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={n}")


def replayed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' ticks written as files, streamed to bars until used up, then read back: all bars, as a batch would give."""
    place = shared_folder(spark, "stream")
    # Microseconds: of two ticks in one millisecond the earlier opens and the later closes.
    moment = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', at)"))
    ticks = bridge.ticks(spark, sf_dir).select("symbol", moment.alias("at"), "px", F.lit(1.0).alias("qty"))
    ticks.write.parquet(f"{place}/ticks/part=1")
    # A closing tick of no symbol, some hours on, lets the watermark pass the last bars.
    closing = spark.read.parquet(f"{place}/ticks/part=1").agg(F.max("at").alias("at")).select(F.lit(None).cast("string").alias("symbol"), (F.col("at") + F.expr("interval 3 hours")).alias("at"), F.lit(0.0).alias("px"), F.lit(0.0).alias("qty"))
    closing.write.parquet(f"{place}/ticks/part=2")
    live = stream_bars(stream_ticks(spark, f"{place}/ticks/*", ticks.schema))
    # Not filtered in the stream: that would take the closing tick away before the watermark sees it.
    run(live, lambda batch, n: put(batch.filter("symbol is not null"), f"{place}/bars", n), f"{place}/state")
    return before(spark, f"{place}/bars", 2**62, live.schema)


def session_totals(bars: DataFrame, windows: DataFrame, late: str = "2 days") -> DataFrame:
    """Each session's bar count, extremes and volume so far, from a stream of bars; a session's state goes once the watermark has passed its end."""
    inside = assign(bars, windows).withColumn("until", F.timestamp_millis("end_ts")).withWatermark("until", late)
    return inside.groupBy(*derive.KEYS, "until").agg(F.count("*").alias("bar_count"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")).drop("until")


def replayed_sessions(spark: SparkSession, bars: DataFrame, windows: DataFrame) -> DataFrame:
    """bars as files, streamed against the calendar: the last totals of each session."""
    place = shared_folder(spark, "stream")
    bars.write.parquet(f"{place}/bars")
    windows.write.parquet(f"{place}/windows")
    made = session_totals(spark.readStream.schema(bars.schema).parquet(f"{place}/bars"), spark.read.parquet(f"{place}/windows"))
    run(made, lambda batch, n: put(batch.withColumn("n", F.lit(n)), f"{place}/sessions", n), f"{place}/state", "update")
    rows = spark.read.parquet(f"{place}/sessions")
    values = ("bar_count", "high", "low", "volume")
    return rows.groupBy(*derive.KEYS).agg(F.max_by(F.struct(*values), "n").alias("v")).select(*derive.KEYS, *(f"v.{c}" for c in values))


def replay(spark: SparkSession, ledger: str, alert_id: str | None = None, n: int = 50) -> DataFrame:
    """The newest alerts by their time of firing (500 at most), or one by its id, as they were stored."""
    rows = spark.read.parquet(ledger)
    return rows.filter(F.col("id") == alert_id) if alert_id else rows.orderBy(F.desc("fired_at"), "id").limit(min(max(n, 0), 500))
