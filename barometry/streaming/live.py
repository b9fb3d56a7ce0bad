"""Watches over a stream of bars: developing sessions in keyed state, phases, a board, alerts.

Each series (symbol, tf, source) has a state: the time of its last bar, and its open sessions
as parts (``operators.partials``). A batch costs what its own bars and the open sessions cost,
however long the stream has run: no stored bar is read again, and the past is asked through
stored tallies (``plans.tallies``).

A batch writes folders of its own number and reads those of the batch before it, so one that
runs again after a failure leaves nothing twice.
"""

import datetime
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.scalars import DAY_MS, MINUTE_MS
from ..functions.stats import WARN
from ..operators import derive, partials
from ..plans import envelope, tallies
from ..plans.catalog import Preset
from . import monitor

SERIES = ["symbol", "session_key"]
_TOUCHED = "symbol string, tf string, source string, session_key string, trade_date date, start_ts long, end_ts long, is_half_day boolean, part string, ended boolean"
_STATE = "last_ts long, sessions string"
#: Without bars for so long, a series' open sessions are given up; the time of its last bar stays.
IDLE_MS = 3 * DAY_MS
_NEVER = -(2**62)


class Watch(NamedTuple):
    """A question watched: of one symbol and session (None: of all), alerting when the estimate is at least or at most so much on n_least sessions."""

    question: Preset
    symbol: str | None = None
    session_key: str | None = None
    least: float | None = None
    most: float | None = None
    n_least: int = WARN

    @property
    def id(self) -> str:
        return "/".join([self.question.name, *(x for x in (self.symbol, self.session_key) if x), *(f"{s}{x}" for s, x in ((">=", self.least), ("<=", self.most)) if x is not None)])


def watch_table(spark: SparkSession, watches: Sequence[Watch]) -> DataFrame:
    rows = [(w.id, w.question.name, w.symbol, w.session_key, w.least, w.most, w.n_least) for w in watches]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("two watches are the same")
    return spark.createDataFrame(rows, "watch_id string, qid string, w_symbol string, w_session string, least double, most double, n_least long")


def _questions(watches: Sequence[Watch]) -> list[Preset]:
    found = {w.question.name: w.question for w in watches}
    if any(w.question != found[w.question.name] for w in watches):
        raise ValueError("two questions have one name")
    return list(found.values())


# Keyed state.


def _new_part(row, windows: tuple[int, ...]) -> dict:
    return {"bar_count": 0, "volume": 0.0, "first": None, "last": None, "contract_first": None, "contract_last": None} | {f"bars{w}": 0 for w in windows} | {name: [] for name, _, _ in partials.stairs(windows)}


def add_bar(part: dict, row, windows: tuple[int, ...]) -> None:
    """Fold a bar, later than all before it, into a part."""
    at = lambda v: {"ts": int(row.ts), "v": v}
    part["bar_count"] += 1
    part["volume"] += float(row.volume)
    part["last"] = at(float(row.close))
    part["first"] = part["first"] or at(float(row.open))
    if row.contract is not None and row.contract == row.contract:
        part["contract_last"] = at(row.contract)
        part["contract_first"] = part["contract_first"] or at(row.contract)
    for w in windows:
        part[f"bars{w}"] += row.ts < row.start_ts + w * MINUTE_MS
    for name, w, up in partials.stairs(windows):
        v, steps = float(row.high if up else row.low), part[name]
        if row.ts >= row.start_ts + w * MINUTE_MS and (not steps or (v > steps[-1]["v"] if up else v < steps[-1]["v"])):
            steps.append(at(v))


def follow(windows: tuple[int, ...] = partials.OR_WINDOWS, idle_ms: int | None = IDLE_MS) -> Callable:
    """The state's step: accept a series' bars that are later than its last, fold them into its open sessions, and tell those that they touched or ended."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, held = state.get if state.exists else (_NEVER, "{}")
        sessions = json.loads(held)
        if state.hasTimedOut:
            state.update((last_ts, "{}"))
            return
        rows = pd.concat(list(frames))
        rows = rows[rows["ts"] > last_ts].sort_values(["ts", "open", "high", "low", "close"], kind="stable")
        rows = rows.drop_duplicates(["ts", "session_key", "trade_date"])
        touched = set()
        for row in rows.itertuples(index=False):
            if row.session_key is None or row.session_key != row.session_key:
                continue
            name = f"{row.session_key}|{row.trade_date}"
            found = sessions.setdefault(name, {"session_key": row.session_key, "trade_date": str(row.trade_date), "start_ts": int(row.start_ts), "end_ts": int(row.end_ts), "is_half_day": bool(row.is_half_day), "part": _new_part(row, windows)})
            add_bar(found["part"], row, windows)
            touched.add(name)
        if len(rows):
            last_ts = int(rows["ts"].max())
        out = []
        for name in sorted(sessions):
            s = sessions[name]
            ended = s["end_ts"] <= last_ts
            if ended or name in touched:
                out.append((*key, s["session_key"], datetime.date.fromisoformat(s["trade_date"]), s["start_ts"], s["end_ts"], s["is_half_day"], json.dumps(s["part"]), ended))
            if ended:
                del sessions[name]
        state.update((last_ts, json.dumps(sessions)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _TOUCHED.split(", ")])

    return step


def touched_sessions(bars: DataFrame, windows: DataFrame, or_windows: tuple[int, ...] = partials.OR_WINDOWS, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Of a stream of bars (symbol, tf, source, ts, open, high, low, close, volume, contract): each session that a batch adds bars to or ends, as a part in JSON.

    A series' bars count once and in order: those not later than its last are dropped, whatever
    other series have. Bars outside all windows move their series on. With
    idle_ms there is a batch at each trigger, with or without bars; without it (for streams that
    are used up) only bars make batches.
    """
    day = lambda x: F.floor(x / F.lit(DAY_MS))
    spread = windows.select("symbol", "session_key", "trade_date", "start_ts", "end_ts", "is_half_day", F.explode(F.sequence(day(F.col("start_ts")), day(F.col("end_ts") - 1))).alias("day"))
    w, b = spread.alias("w"), bars.withColumn("day", day(F.col("ts"))).alias("b")
    inside = b.join(w, F.expr("b.symbol = w.symbol and b.day = w.day and b.ts >= w.start_ts and b.ts < w.end_ts"), "left")
    rows = inside.select(*(F.col(f"b.{c}") for c in ("symbol", "tf", "source", "ts", "open", "high", "low", "close", "volume", "contract")), *(F.col(f"w.{c}") for c in ("session_key", "trade_date", "start_ts", "end_ts", "is_half_day")))
    return rows.groupBy("symbol", "tf", "source").applyInPandasWithState(follow(or_windows, idle_ms), _TOUCHED, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def carried(touched: DataFrame, place: str, n: int, now_ms: int) -> DataFrame:
    """Write the open sessions after batch n: those it touched, and those of the batch before that it did not and that are not over."""
    spark = touched.sparkSession
    own = [*SERIES, "tf", "source", "trade_date"]
    before = tallies.stored(spark, f"{place}/sessions/batch={n - 1}", touched.schema).filter(~F.col("ended") & (F.col("end_ts") > now_ms))
    monitor.put(touched.unionByName(before.join(touched.select(own), own, "left_anti")), f"{place}/sessions", n)
    return spark.read.schema(touched.schema).parquet(f"{place}/sessions/batch={n}")


def parts_of(sessions: DataFrame, or_windows: tuple[int, ...] = partials.OR_WINDOWS) -> DataFrame:
    """The sessions' parts as columns; those of several sources or bar sizes of one session are one."""
    rows = sessions.withColumn("p", F.from_json("part", partials.schema(or_windows))).select(*partials.FRAME, "p.*")
    return partials.merged(rows, or_windows)


# Evaluation.


def phases(table: DataFrame, watches: Sequence[Watch], series: DataFrame, rows: DataFrame, now_ms: int) -> DataFrame:
    """Each watch on each of its series (symbol, session_key, latest: its last trade date): trade_date, today (only sessions before it count), fits and phase.

    rows: features of the sessions that go on, one a series. Without one a watch is resolved; else
    active where its condition holds (or it has none), else forming; a null condition does not hold.
    """
    fits = lambda q: F.lit(True) if q.where == "true" else F.coalesce(F.expr(q.where), F.lit(False))
    asked = F.array(*(F.struct(F.lit(q.name).alias("qid"), fits(q).alias("fits")) for q in _questions(watches)))
    live = rows.select(*SERIES, F.col("trade_date").alias("live"), F.explode(asked).alias("w")).select(*SERIES, "live", "w.*")
    mine = series.join(table, (F.col("w_symbol").isNull() | (F.col("w_symbol") == F.col("symbol"))) & (F.col("w_session").isNull() | (F.col("w_session") == F.col("session_key"))))
    out = mine.join(live, [*SERIES, "qid"], "left")
    phase = F.when(F.col("live").isNull(), "resolved").when(F.col("fits"), "active").otherwise("forming")
    date = F.coalesce("live", "latest", F.timestamp_millis(F.lit(now_ms)).cast("date"))
    return out.withColumns({"phase": phase, "trade_date": date}).select("watch_id", "qid", *SERIES, "trade_date", "phase", "least", "most", "n_least")


def evaluated(states: DataFrame, asked: DataFrame) -> DataFrame:
    """states with the answers (tallies.answered()) to their questions; a question without sessions has n 0."""
    out = states.join(asked, [*SERIES, "qid"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0)), "low_sample": F.coalesce("low_sample", F.lit(True)), "refused": F.coalesce("refused", F.lit(True))})


_SNAPSHOT = ["qid", "least", "most", "n_least", "n", "k", "estimate", "ci_low", "ci_high", "low_sample", "n1", "k1", "n2", "k2", "agree", "n_recent", "k_recent", "diverges"]


def alerts(states: DataFrame, now_ms: int, fingerprint: str = "") -> DataFrame:
    """Alerts of active watches whose estimate crosses their own threshold on enough sessions.

    The id names series, date, question and threshold, so a watch fires once a day and series.
    The snapshot has all that the alert rests on.
    """
    crossed = F.coalesce(F.col("estimate") >= F.col("least"), F.lit(False)) | F.coalesce(F.col("estimate") <= F.col("most"), F.lit(False))
    rows = states.filter((F.col("phase") == "active") & F.col("estimate").isNotNull() & (F.col("n") >= F.col("n_least")) & crossed)
    digest = F.substring(F.sha2(F.concat_ws("|", "qid", F.coalesce(F.col("least").cast("string"), F.lit("-")), F.coalesce(F.col("most").cast("string"), F.lit("-"))), 256), 1, 12)
    text = F.format_string(f"%s %s %s %s: %.4f [%.4f, %.4f], N=%d. {monitor.DISCLAIMER}", "symbol", "session_key", F.col("trade_date").cast("string"), "watch_id", "estimate", "ci_low", "ci_high", "n")
    snapshot = F.struct(*_SNAPSHOT, F.lit(fingerprint).alias("fingerprint"))
    return rows.select(F.concat_ws("|", "symbol", "session_key", F.col("trade_date").cast("string"), digest).alias("id"), F.timestamp_millis(F.lit(now_ms)).alias("fired_at"), "symbol", "session_key", "trade_date", "watch_id", snapshot.alias("snapshot"), text.alias("text"))


def fire(found: DataFrame, place: str, n: int, days: int = 7) -> DataFrame:
    """Put the alerts of batch n that have not fired yet into place/ledger, and return them.

    What has fired is carried from batch to batch for some days past its trade date, so the
    ledger itself is never read.
    """
    spark = found.sparkSession
    old = tallies.stored(spark, f"{place}/fired/batch={n - 1}", found.select("id", "trade_date").schema)
    new = found.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(found.columns)
    monitor.put(new, f"{place}/ledger", n)
    new = spark.read.schema(found.schema).parquet(f"{place}/ledger/batch={n}")
    kept = old.join(old.agg(F.max("trade_date").alias("last")), F.date_add("trade_date", days) >= F.col("last")).select(old.columns)
    monitor.put(kept.unionByName(new.select("id", "trade_date")), f"{place}/fired", n)
    return new


def forget(spark: SparkSession, place: str, n: int) -> None:
    """Remove what batches before the one before n have left but for the ledger; batch n may run again and reads one back."""
    for name in ("sessions", "features", "states", "fired"):
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{name}/batch={n - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


class Board:
    """The watches' last states, in folders by number; readers take the newest whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        done = lambda p: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(f.getPath().getName()) for f in system.listStatus(place) if done(f.getPath()))

    def newest(self) -> DataFrame | None:
        numbers = self._numbers()
        return self.spark.read.parquet(f"{self.path}/{numbers[-1]}") if numbers else None

    def publish(self, states: DataFrame, now_ms: int, enabled: bool = True, sync_error: str | None = None) -> None:
        """Put states on the board, with the time, whether watching goes on, and why bars may be stale. Readers of the board before keep theirs."""
        named = {"updated_at": F.timestamp_millis(F.lit(now_ms)), "enabled": F.lit(enabled), "sync_error": F.lit(sync_error).cast("string")}
        numbers = self._numbers()
        states.withColumns(named).write.parquet(f"{self.path}/{numbers[-1] + 1 if numbers else 0}")
        for old in numbers[:-2]:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}")
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def switch_off(self, now_ms: int) -> None:
        """Mark the last states as no longer watched."""
        last = self.newest()
        if last is not None:
            self.publish(last.drop("updated_at", "enabled", "sync_error"), now_ms, enabled=False)


class History(NamedTuple):
    """What is known of sessions before: own_features() of the last ones of each series (for developing rows), the tallies' store, and each series' latest trade date."""

    own: DataFrame
    tallies: str
    series: DataFrame
    fingerprint: str = ""


def history(past: DataFrame, own: DataFrame, windows: DataFrame, watches: Sequence[Watch], place: str, fingerprint: str = "") -> History:
    """past: features of all sessions with what the questions name; own: own_features() of the same. Only series that have changed are tallied again."""
    tallies.refresh(past, _questions(watches), f"{place}/history")
    latest = past.groupBy(*SERIES).agg(F.max("trade_date").alias("latest"))
    series = windows.select(*SERIES).distinct().join(latest, SERIES, "left")
    monitor.put(series, f"{place}/series", 0)
    return History(own, f"{place}/history", past.sparkSession.read.schema(series.schema).parquet(f"{place}/series/batch=0"), fingerprint)


def wall_clock() -> int:
    return int(time.time() * 1000)


def watch(bars: DataFrame, place: str, windows: DataFrame, known: History, watches: Sequence[Watch], bar_ms: int, events: DataFrame | None = None, clock: Callable[[], int] = wall_clock, sync: Callable[[], None] | None = None, every: str | None = None, emit: Callable[[DataFrame], None] | None = None, warn: int = WARN, refuse: int = 10) -> None:
    """Follow a stream of bars until it is used up or, with every (a time such as "30 seconds"), until it is stopped.

    Each batch reads the clock, then runs sync (which lands new bars; if it fails, the board says
    so and the batch goes on with what is there), and writes place/sessions, features,
    board and ledger. emit is handed the alerts that a batch fires. However the stream
    ends, by a failing batch too, the board is switched off.

    events: (date, event), for questions that name them.
    """
    spark = bars.sparkSession
    table = watch_table(spark, watches)
    questions, names = _questions(watches), sorted(r.event for r in events.select("event").distinct().collect()) if events is not None else []
    board = Board(spark, f"{place}/board")

    def each(batch: DataFrame, n: int) -> None:
        now_ms, failed = clock(), None
        if sync:
            try:
                sync()
            except Exception as e:  # noqa: BLE001
                failed = f"{type(e).__name__}: {e}"
        open_now = carried(batch, place, n, now_ms).filter((F.col("start_ts") <= now_ms) & (F.col("end_ts") > now_ms))
        rows = derive.developing_series(known.own, parts_of(open_now), bar_ms)
        if events is not None:
            rows = envelope.with_events(rows, events, names)
        newest = Window.partitionBy(*SERIES).orderBy(F.desc("trade_date"))
        monitor.put(rows.filter("live"), f"{place}/features", n)
        live = spark.read.schema(rows.schema).parquet(f"{place}/features/batch={n}")
        going = live.filter("not complete").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        last = live.groupBy(*SERIES).agg(F.max("trade_date").alias("own"))
        series = known.series.join(last, SERIES, "left").select(*SERIES, F.greatest("latest", "own").alias("latest"))
        states = phases(table, watches, series, going, now_ms)
        # Each series is asked up to the day before its own date; all its watches have that date.
        before = states.groupBy(*SERIES).agg(F.max("trade_date").alias("today"))
        asked = tallies.answered(tallies.read(spark, known.tallies), before, warn=warn, refuse=refuse)
        monitor.put(evaluated(states, asked), f"{place}/states", n)
        made = spark.read.parquet(f"{place}/states/batch={n}")
        board.publish(made, now_ms, sync_error=failed)
        fired = fire(alerts(made, now_ms, known.fingerprint), place, n)
        if emit:
            emit(fired)
        forget(spark, place, n)

    found = touched_sessions(bars, windows, idle_ms=IDLE_MS if every else None).writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(each)
    try:
        (found.trigger(processingTime=every) if every else found.trigger(availableNow=True)).start().awaitTermination()
    finally:
        board.switch_off(clock())


def last_features(spark: SparkSession, place: str) -> DataFrame:
    """The developing sessions' features after the last batch of watch()."""
    rows = spark.read.parquet(f"{place}/features")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch", "live")
