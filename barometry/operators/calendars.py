"""Calendar-resolved session windows, and bars assigned to them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, MINUTE_MS

#: Built-in sessions by exchange: key, start and end minute of the day, zone, overnight, every day of the week; fixed values.
BUILT_IN = {
    "NYSE": [("rth", 570, 960, "America/New_York", False, False)],
    "CME": [("rth", 570, 960, "America/New_York", False, False), ("globex", 1080, 1020, "America/New_York", True, False)],
    "CRYPTO": [("utc", 0, 1440, "UTC", False, True), ("ny", 570, 960, "America/New_York", False, True)],
    "FX": [("sydney", 1260, 360, "UTC", True, False), ("tokyo", 0, 540, "UTC", False, False), ("london", 420, 960, "UTC", False, False), ("newyork", 720, 1260, "UTC", False, False)],
}
DEFS = "session_key string, start_min int, end_min int, tz string, overnight boolean, every_day boolean"
#: Exchange and default session of each asset class; fixed values.
DEFAULTS = {"equity": ("NYSE", "rth"), "future": ("CME", "rth"), "crypto": ("CRYPTO", "utc"), "forex": ("FX", "london")}


def definitions(spark: SparkSession, exchange: str, overrides: list[tuple] = ()) -> DataFrame:
    """An exchange's sessions; an override replaces the built-in one of its key."""
    rows = {r[0]: r for r in BUILT_IN[exchange]} | {r[0]: r for r in overrides}
    return spark.createDataFrame(list(rows.values()), DEFS)


def with_defaults(symbols: DataFrame) -> DataFrame:
    """symbols (symbol, asset_class and maybe exchange and default_session) with the class's exchange and session where none is named; an unknown class has none."""
    named = lambda k: F.col(k) if k in symbols.columns else F.lit(None).cast("string")
    by_class = lambda i: F.coalesce(*(F.when(F.col("asset_class") == c, v[i]) for c, v in DEFAULTS.items()))
    return symbols.withColumns({"exchange": F.coalesce(named("exchange"), by_class(0)), "default_session": F.coalesce(named("default_session"), by_class(1))})


def symbol_definitions(symbols: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """symbol and the columns of DEFS: the sessions of each symbol's exchange, and its overrides (symbol and DEFS), which add sessions or replace those of their key."""
    spark = symbols.sparkSession
    built_in = spark.createDataFrame([(exchange, *d) for exchange, some in BUILT_IN.items() for d in some], f"exchange string, {DEFS}")
    # Every built-in session has a row; symbols stay as they are dealt.
    own = with_defaults(symbols).select("symbol", "exchange").join(F.broadcast(built_in), "exchange").drop("exchange")
    if overrides is None:
        return own
    return own.join(overrides.select("symbol", "session_key"), ["symbol", "session_key"], "left_anti").unionByName(overrides)


def spans(bars: DataFrame) -> DataFrame:
    """Per symbol, the days that its windows must cover: from 3 before its first bar to 2 after its last."""
    day = lambda x: F.date_from_unix_date(F.floor(x / DAY_MS).cast("int"))
    return bars.groupBy("symbol").agg(F.date_sub(day(F.min("ts")), 3).alias("first"), F.date_add(day(F.max("ts")), 2).alias("last"))


def _wall_ms(date, minute, tz):
    """Epoch ms of a wall-clock minute of a date in a zone; daylight saving is resolved, minute 1440 is the next midnight."""
    naive = F.timestamp_millis(F.unix_date(date).cast("long") * DAY_MS + minute.cast("long") * MINUTE_MS)
    return F.unix_millis(F.to_utc_timestamp(naive, tz))


def session_windows(symbols: DataFrame, defs: DataFrame, holidays: DataFrame | None = None, half_days: DataFrame | None = None) -> DataFrame:
    """symbol, session_key, trade_date, start_ts, end_ts (half-open, ms) and is_half_day.

    symbols: symbol, first, last. defs: any number of rows, for all symbols or (with a column
    symbol) for one each. holidays: date. half_days: date and
    close_min in the session's zone. Weekends are left out unless a session is for every day;
    an overnight session starts on the day before its trade date.
    """
    days = symbols.select("symbol", F.explode(F.sequence("first", "last")).alias("trade_date"))
    # A weekday has sessions of both kinds, a day of the weekend those of every day.
    of_kind = F.explode(F.when(F.weekday("trade_date") < 5, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    rows = days.withColumn("every_day", of_kind).join(defs.withColumn("every_day", F.coalesce("every_day", F.lit(False))), ["every_day", *(["symbol"] if "symbol" in defs.columns else [])])
    if holidays is not None:
        rows = rows.join(holidays.select(F.col("date").alias("trade_date")).distinct(), "trade_date", "left_anti")
    rows = rows.withColumn("start_ts", _wall_ms(F.when(F.col("overnight"), F.date_sub("trade_date", 1)).otherwise(F.col("trade_date")), F.col("start_min"), F.col("tz"))).withColumn("end_ts", _wall_ms(F.col("trade_date"), F.col("end_min"), F.col("tz")))
    if half_days is None:
        rows = rows.withColumn("is_half_day", F.lit(False))
    else:
        early = half_days.groupBy(F.col("date").alias("trade_date")).agg(F.min("close_min").alias("close_min"))
        rows = rows.join(early, "trade_date", "left").withColumn("is_half_day", F.col("close_min").isNotNull())
        rows = rows.withColumn("end_ts", F.when(F.col("is_half_day"), F.least("end_ts", _wall_ms(F.col("trade_date"), F.col("close_min"), F.col("tz")))).otherwise(F.col("end_ts")))
    return rows.filter("end_ts > start_ts").select("symbol", "session_key", "trade_date", "start_ts", "end_ts", "is_half_day")


def calendar(windows: DataFrame, symbol: str, since: str, until: str) -> DataFrame:
    """One symbol's windows with trade dates from since to until, both included."""
    return windows.filter((F.col("symbol") == symbol) & F.col("trade_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def _day(ts: Column) -> Column:
    return F.floor(ts / DAY_MS)


def assign(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars inside [start_ts, end_ts) of their symbol's windows.

    A range join as an equi-join: each window is listed for the UTC days it touches, so both
    sides are dealt by (symbol, day) and long histories spread.
    """
    touched = windows.withColumn("day", F.explode(F.sequence(_day(F.col("start_ts")), _day(F.col("end_ts") - 1))))
    return bars.withColumn("day", _day(F.col("ts"))).join(touched, ["symbol", "day"]).filter("ts >= start_ts and ts < end_ts").drop("day")


def keep_together(bars: DataFrame, windows: DataFrame, name: str, path: str, buckets: int) -> None:
    """Store bars, and the days that each window touches, as tables <name>_bars and <name>_windows below path, both bucketed by (symbol, day): joining and aggregating them then shuffles no bar."""
    made = {"bars": bars.withColumn("day", _day(F.col("ts"))), "windows": windows.withColumn("day", F.explode(F.sequence(_day(F.col("start_ts")), _day(F.col("end_ts") - 1))))}
    for kind, rows in made.items():
        rows.repartition(buckets, "symbol", "day").write.mode("overwrite").option("path", f"{path}/{kind}").bucketBy(buckets, "symbol", "day").sortBy("symbol", "day").saveAsTable(f"{name}_{kind}")


def assign_together(spark: SparkSession, name: str) -> DataFrame:
    """assign() of the tables that keep_together() wrote, with each bar's day; partials by day merge to sessions."""
    inside = spark.table(f"{name}_bars").join(spark.table(f"{name}_windows"), ["symbol", "day"])
    return inside.filter((F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts")))
