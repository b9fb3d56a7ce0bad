"""Answers about single sessions, and about the store."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .derive import IB_WINDOW, KEYS, OR_WINDOWS

#: Name, level column and minute column of a session's price levels.
LEVELS = (("open", "open", "0"), ("high", "high", "high_time_min"), ("low", "low", "low_time_min"), ("close", "close", "null"), ("prev_mid", "prev_mid", "null"), ("prev_close", "prev_close", "gap_fill_min"), ("prev_high", "prev_high", "touch_prev_high_min"), ("prev_low", "prev_low", "touch_prev_low_min"), *((f"or{w}_{side}", f"or{w}_{side}", f"or{w}_break_min") for w in OR_WINDOWS for side in ("high", "low")))
HOUR_MS = 3_600_000
#: A longer window is no session; of one session, and of context before it, no more bars are given.
MOST_SESSION_MS, MOST_SESSION_BARS, MOST_CONTEXT = 36 * HOUR_MS, 5000, 240


def drilldown(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The feature rows of the sessions named in wanted (session_id)."""
    return rows.join(wanted.select("session_id").distinct(), "session_id", "left_semi")


def session_bars(assigned: DataFrame, which: Column, cap: int | None = MOST_SESSION_BARS) -> DataFrame:
    """Bars of the sessions that which selects; an error if a session is longer than 36 hours, or has more bars than cap (None: no bound)."""
    rows = assigned.filter(which)
    if "end_ts" in rows.columns:
        rows = rows.withColumn("ts", F.when(F.col("end_ts") - F.col("start_ts") > MOST_SESSION_MS, F.raise_error(F.lit("a session is longer than 36 hours"))).otherwise(F.col("ts")))
    if cap:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("ts"))).withColumn("ts", F.when(F.col("_n") > cap, F.raise_error(F.lit(f"more than {cap} bars in a session"))).otherwise(F.col("ts"))).drop("_n")
    return rows


def context_bars(bars: DataFrame, windows: DataFrame, bar_ms: int, n: int = 30, lookback_ms: int = 7 * 24 * HOUR_MS) -> DataFrame:
    """The last n bars (brought into 0 to MOST_CONTEXT) before each session's start, labelled pre-session if the last is at most two bars old, else prior-session.

    Windows are listed for the days of their lookback, so this too is an equi-join.
    """
    n = min(max(n, 0), MOST_CONTEXT)
    day = lambda x: F.floor(x / F.lit(24 * HOUR_MS))
    touched = windows.select(*KEYS, "start_ts", F.explode(F.sequence(day(F.col("start_ts") - lookback_ms), day(F.col("start_ts") - 1))).alias("day"))
    near = bars.withColumn("day", day(F.col("ts"))).join(touched, ["symbol", "day"]).filter((F.col("ts") < F.col("start_ts")) & (F.col("ts") >= F.col("start_ts") - lookback_ms))
    own = Window.partitionBy(*KEYS)
    ranked = near.withColumn("back", F.row_number().over(own.orderBy(F.desc("ts")))).withColumn("last", F.max("ts").over(own)).filter(F.col("back") <= n)
    return ranked.select(*KEYS, "ts", "close", F.when(F.col("start_ts") - F.col("last") <= 2 * bar_ms, "pre-session").otherwise("prior-session").alias("label"))


def context_labels(windows: DataFrame, context: DataFrame) -> DataFrame:
    """Every session's label; none where it has no context bars."""
    return windows.select(*KEYS).join(context.groupBy(*KEYS).agg(F.first("label").alias("label")), KEYS, "left").withColumn("label", F.coalesce("label", F.lit("none")))


def levels(rows: DataFrame) -> DataFrame:
    """session_id, name, level and minute of every known price level."""
    each = [F.struct(F.lit(name).alias("name"), F.col(value).cast("double").alias("level"), F.expr(minute).cast("int").alias("minute")) for name, value, minute in LEVELS]
    return rows.select("session_id", F.explode(F.array(*each)).alias("x")).select("session_id", "x.*").filter("level is not null")


def level_facts(rows: DataFrame, ib_window: int = IB_WINDOW) -> DataFrame:
    """One row per session beside its levels: the gap and what became of it, the levels of the session before that were touched, the initial balance's break and each opening range's first one."""
    ranges = F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"or{w}_high").alias("high"), F.col(f"or{w}_low").alias("low"), F.col(f"or{w}_first_break").alias("first_break"), F.col(f"or{w}_break_min").alias("break_min")) for w in OR_WINDOWS))
    return rows.select("session_id", "gap_abs", "gap_pct", "gap_dir", "gap_filled", "touched_prev_high", "touched_prev_low", "ib_break", F.lit(ib_window).alias("ib_window"), ranges.alias("opening_ranges"))


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "session_key").agg(F.count("*").alias("sessions"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


def freshness(bars: DataFrame, now_ms: int, symbols: DataFrame | None = None) -> DataFrame:
    """The last bar of each symbol (and tf, where bars have it): fresh up to 26 hours, aging up to 7 days, else stale; none for those of symbols without bars."""
    keys = [k for k in ("symbol", "tf") if k in bars.columns]
    age = F.lit(now_ms) - F.col("last_ts")
    last = bars.groupBy(*keys).agg(F.max("ts").alias("last_ts"))
    if symbols is not None:
        last = symbols.join(last, [k for k in keys if k in symbols.columns], "left")
    return last.withColumn("class", F.when(F.col("last_ts").isNull(), "none").when(age <= 26 * HOUR_MS, "fresh").when(age <= 7 * 24 * HOUR_MS, "aging").otherwise("stale"))


def fingerprint(bars: DataFrame, rows: DataFrame, calendar: str, version: str = "1") -> DataFrame:
    """12 hex digits that change with the store's bars, features or calendar."""
    a = bars.agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    b = rows.agg(F.count("*").alias("m"), F.max("trade_date").alias("d"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("t").cast("string"), F.col("m").cast("string"), F.col("d").cast("string"), F.lit(calendar), F.lit(version))
    return a.join(b, F.lit(True)).select(F.substring(F.sha2(text, 256), 1, 12).alias("fingerprint"))


def provenance(stamp: DataFrame, calendar: DataFrame, version: str, asked: dict[str, str | None]) -> DataFrame:
    """What an answer rests on: the store's fingerprint, a hash of the calendar's rows, the version, and the question itself.

    The calendar's hash is a sum of row hashes, so it needs no order and no single task.
    """
    rows = F.to_json(F.struct(*(F.col(c).cast("string") for c in sorted(calendar.columns))))
    digest = calendar.select(F.conv(F.substring(F.sha2(rows, 256), 1, 12), 16, 10).cast("decimal(20,0)").alias("h")).agg(F.lower(F.hex((F.coalesce(F.sum("h"), F.lit(0)) % F.lit(2**48)).cast("long"))).alias("calendar_version"))
    echo = [F.lit(v).cast("string").alias(k) for k, v in asked.items()]
    return stamp.join(digest, F.lit(True)).select("fingerprint", "calendar_version", F.lit(version).alias("version"), *echo)
