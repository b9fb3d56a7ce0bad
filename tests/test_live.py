"""Session parts that merge, keyed state, and watches over a stream."""

import json
import random
from types import SimpleNamespace

import duckdb
import pytest
from barometry import queries
from barometry.operators import calendars, derive, partials
from barometry.plans import catalog, envelope, tallies
from barometry.plans.catalog import Preset
from barometry.streaming import live, monitor
from barometry.streaming.live import Watch
from pyspark.sql import functions as F

DAY, HOUR, MINUTE = 86_400_000, 3_600_000, 60_000
BARS = "symbol string, tf string, source string, ts long, open double, high double, low double, close double, volume double, contract string"


def some_bars(days, seed, symbols=("A", "B"), step=10 * MINUTE):
    pick, rows = random.Random(seed), []
    for symbol in symbols:
        price = 100.0
        for ts in range(0, days * DAY, step):
            if pick.random() < 0.1:
                continue
            opened = price
            price += pick.choice([-1.5, -0.5, 0.0, 0.5, 1.0])
            rows.append((symbol, "10m", "feed", ts, opened, max(opened, price) + pick.choice([0.0, 0.5, 2.0]), min(opened, price) - pick.choice([0.0, 0.5, 2.0]), price, float(pick.randrange(9)), pick.choice([None, "Z4" if ts < 3 * DAY else "H5"])))
    return rows


def windows_of(spark, bars):
    defs = spark.createDataFrame([("utc", 0, 1440, "UTC", False, True), ("late", 1080, 1020, "America/New_York", True, True)], calendars.DEFS)
    return calendars.session_windows(calendars.spans(bars), defs)


def plain_part(rows):
    """A part, from a list of bars, bar by bar."""
    part = live._new_part(None, partials.OR_WINDOWS)
    for r in sorted(rows, key=lambda r: r.ts):
        live.add_bar(part, r, partials.OR_WINDOWS)
    return part


def as_dict(row):
    return json.loads(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if k not in partials.FRAME}))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parts_of_any_split_give_the_session(spark, seed):
    bars = spark.createDataFrame(some_bars(5, seed), BARS)
    assigned = calendars.assign(bars, windows_of(spark, bars))
    whole = partials.partials(assigned).orderBy(*partials.KEYS)
    split = assigned.withColumn("piece", F.abs(F.xxhash64("ts", F.lit(seed))) % 7)
    parts = None
    for i in range(7):
        one = partials.partials(split.filter(F.col("piece") == i).drop("piece"))
        parts = one if parts is None else parts.unionByName(one)
    merged = partials.merged(parts).orderBy(*partials.KEYS)
    got, want = [[as_dict(r) for r in x.collect()] for x in (merged, whole)]
    assert got == want and len(want) > 8
    # Merging in two steps gives the same, and so does keeping the bars of a day together.
    halves = partials.merged(parts.limit(5)).unionByName(partials.merged(parts.subtract(parts.limit(5))))
    assert [as_dict(r) for r in partials.merged(halves).orderBy(*partials.KEYS).collect()] == want
    by_day = partials.merged(partials.partials(assigned.withColumn("day", F.expr("ts div 86400000")), within=("day",)))
    assert [as_dict(r) for r in by_day.orderBy(*partials.KEYS).collect()] == want
    # The state's own step, bar by bar.
    rows = assigned.collect()
    for r, w in zip(whole.collect(), want, strict=True):
        assert plain_part([x for x in rows if all(x[k] == r[k] for k in partials.KEYS)]) == w


def test_stats_equal_a_plain_scan(spark):
    bars = spark.createDataFrame(some_bars(4, 9, ("A",)), BARS)
    assigned = calendars.assign(bars, windows_of(spark, bars))
    by = {}
    for r in sorted(assigned.collect(), key=lambda r: r.ts):
        by.setdefault((r.session_key, r.trade_date), []).append(r)
    for s in derive.session_stats(assigned).collect():
        rows = by[s.session_key, s.trade_date]
        top = max(r.high for r in rows)
        assert (s.high, s.high_ts, s.open, s.close) == (top, next(r.ts for r in rows if r.high >= top), rows[0].open, rows[-1].close)
        for w in partials.OR_WINDOWS:
            first = [r for r in rows if r.ts < s.start_ts + w * MINUTE]
            rest = [r for r in rows if r.ts >= s.start_ts + w * MINUTE]
            up = first and next((r.ts for r in rest if r.high > max(x.high for x in first)), None)
            assert s[f"bars{w}"] == len(first) and (s[f"up{w}"] or None) == (up or None)
            assert s[f"pl{w}"] == (min(r.low for r in rest) if rest else None)


def test_features_need_no_python_and_one_shuffle_of_bars(spark, capsys):
    bars = spark.createDataFrame(some_bars(3, 4), BARS)
    derive.features(calendars.assign(bars, windows_of(spark, bars)), 10 * MINUTE).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("hashpartitioning(symbol") and plan.count("trade_date") and sum("Exchange hashpartitioning" in x and "trade_date" in x.split("hashpartitioning")[1] and "open" not in x for x in plan.splitlines()) == 1


def step_by_step(batches, windows_rows, state=None):
    """The state's step without Spark: what each batch gives."""
    import pandas as pd

    held = SimpleNamespace(exists=state is not None, get=state, hasTimedOut=False)

    def update(x):
        held.exists, held.get = True, x

    held.update = update
    step, out = live.follow(idle_ms=None), []
    for rows in batches:
        matched = [{**r, **(w or dict.fromkeys(("session_key", "trade_date", "start_ts", "end_ts", "is_half_day")))} for r in rows for w in ([w for w in windows_rows if w["start_ts"] <= r["ts"] < w["end_ts"]] or [None])]
        out.append(list(pd.concat(list(step(("A", "10m", "feed"), iter([pd.DataFrame(matched)]), held))).itertuples(index=False)))
    return out, held.get


def test_state_keeps_open_sessions_only(spark):
    """200 batches: the state's size and a batch's output don't grow with what has passed."""
    columns = [c.split()[0] for c in BARS.split(", ")]
    bars = [dict(zip(columns, r, strict=True)) for r in some_bars(40, 5, ("A",))]
    days = [{"session_key": "utc", "trade_date": f"2024-01-{d + 1:02d}" if d < 31 else f"2024-02-{d - 30:02d}", "start_ts": d * DAY, "end_ts": (d + 1) * DAY, "is_half_day": False} for d in range(40)]
    size = len(bars) // 200 + 1
    batches = [bars[i : i + size] for i in range(0, len(bars), size)]
    sizes, state, ended = [], None, {}
    for rows in batches:
        # Every batch also brings bars that have been seen.
        ([out], state) = step_by_step([rows + bars[:3]], days, state)
        sizes.append(len(state[1]))
        assert len(out) <= 2 and len(json.loads(state[1])) <= 1
        ended |= {r.trade_date.isoformat(): json.loads(r.part) for r in out if r.ended}
    assert len(batches) >= 190 and max(sizes[100:]) < 1.5 * max(sizes[:100])
    first = [SimpleNamespace(**b, start_ts=0) for b in bars if b["ts"] < DAY]
    assert ended["2024-01-01"] == json.loads(json.dumps(plain_part(first)))
    assert len(ended) == 39


def test_watch_over_a_stream(spark, tmp_path):
    """Batches of one file: two sessions of one day fire each by its own threshold, once; the board ends switched off."""
    place = str(tmp_path)
    rows = some_bars(30, 7)
    bars = spark.createDataFrame(rows, BARS)
    calendar = windows_of(spark, bars)
    calendar.write.parquet(f"{place}/calendar")
    calendar = spark.read.parquet(f"{place}/calendar")
    now = 28 * DAY + 15 * HOUR
    assigned = calendars.assign(bars.filter(F.col("ts") < 28 * DAY), calendar)
    derive.own_features(assigned).filter("end_ts <= %d" % (28 * DAY)).write.parquet(f"{place}/own")
    own = spark.read.parquet(f"{place}/own")
    events = spark.createDataFrame([("1970-01-29", "CPI")], "date string, event string").withColumn("date", F.to_date("date"))
    past = envelope.with_events(derive.series_features(own, 10 * MINUTE), events, ["CPI"])
    green = Preset("green", catalog.close_green())
    watches = [Watch(green, least=0.0, n_least=5), Watch(green, symbol="A", least=1.01, n_least=5), Watch(Preset("cpi", catalog.close_green(), "ev_cpi"), least=0.0, n_least=1)]
    known = live.history(past, own, calendar, watches, f"{place}/live", "f00d")
    for i in range(6):
        part = [r for r in rows if 27 * DAY + i * 7 * HOUR <= r[3] < min(now, 27 * DAY + (i + 1) * 7 * HOUR)]
        spark.createDataFrame(part, BARS).coalesce(1).write.parquet(f"{place}/landed/part={i}")
    stream = lambda: spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{place}/landed/*")
    fired, synced = [], []

    def sync():
        synced.append(1)
        if len(synced) % 2:
            raise OSError("feed is down")

    live.watch(stream(), f"{place}/live", calendar, known, watches, 10 * MINUTE, events, clock=lambda: now, sync=sync, emit=lambda a: fired.extend(a.collect()), refuse=2)
    ledger = monitor.replay(spark, f"{place}/live/ledger").collect()
    assert {(r.symbol, r.session_key) for r in ledger if r.watch_id == "green/>=0.0"} == {(s, k) for s in "AB" for k in ("utc", "late")}
    assert len({r.id for r in ledger}) == len(ledger) == len(fired) and len(synced) == 6
    assert all(r.snapshot.fingerprint == "f00d" and r.snapshot.least == 0.0 and r.snapshot.n >= 5 for r in ledger if r.snapshot.qid == "green")
    assert monitor.replay(spark, f"{place}/live/ledger", ledger[0].id).count() == 1
    board = live.Board(spark, f"{place}/live/board").newest().collect()
    assert {r.enabled for r in board} == {False} and len(board) == 4 + 2 + 4
    # An event on the developing session's own date makes its watch active.
    assert {r.phase for r in board if r.qid == "cpi" and r.session_key == "utc"} == {"active"}
    # Developing features are those of all bars so far.
    whole = calendars.assign(bars.filter(F.col("ts") < now), calendar)
    want = derive.features(whole, 10 * MINUTE).filter(f"start_ts <= {now} and end_ts > {now}")
    got = live.last_features(spark, f"{place}/live").drop("ev_cpi", "next_ev_cpi", "prev_ev_cpi")
    assert sorted(map(str, got.select(sorted(want.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
    # The state's folders of old batches are gone; a batch reads one of them at most.
    assert len(list((tmp_path / "live" / "sessions").iterdir())) <= 3
    # A failing batch leaves the board switched off.
    spark.createDataFrame(rows[:1], BARS).write.parquet(f"{place}/landed/part=9")

    def broken(_):
        raise RuntimeError("no sink")

    with pytest.raises(Exception, match="no sink"):
        live.watch(stream(), f"{place}/live", calendar, known, watches, 10 * MINUTE, events, clock=lambda: now + 1, emit=broken, refuse=2)
    last = live.Board(spark, f"{place}/live/board").newest().collect()
    assert {r.enabled for r in last} == {False} and {r.updated_at.timestamp() for r in last} == {(now + 1) / 1000}


def test_phases_without_a_session_take_the_latest_date(spark):
    series = spark.createDataFrame([("A", "s", "2024-01-04"), ("B", "s", None)], "symbol string, session_key string, latest string").withColumn("latest", F.to_date("latest"))
    rows = spark.createDataFrame([("B", "s", "2024-01-05", None)], "symbol string, session_key string, trade_date string, gap double").withColumn("trade_date", F.to_date("trade_date"))
    watches = [Watch(Preset("any", catalog.close_green())), Watch(Preset("gap", catalog.close_green(), "gap > 1"))]
    found = {(r.qid, r.symbol): (r.phase, str(r.trade_date)) for r in live.phases(live.watch_table(spark, watches), watches, series, rows, 0).collect()}
    assert found == {("any", "A"): ("resolved", "2024-01-04"), ("gap", "A"): ("resolved", "2024-01-04"), ("any", "B"): ("active", "2024-01-05"), ("gap", "B"): ("forming", "2024-01-05")}
    with pytest.raises(ValueError):
        live.watch_table(spark, [watches[0], watches[0]])


def features_of(spark, seed, days=700):
    pick = random.Random(seed)
    rows = [(s, k, d, pick.random() < 0.6, pick.choice(["up", "down", None]), pick.random() < 0.9, pick.uniform(-3, 3)) for s in "ABC" for k in "xy" for d in range(days)]
    frame = spark.createDataFrame(rows, "symbol string, session_key string, d int, green boolean, gap_dir string, complete boolean, ret_oc_pct double")
    return frame.withColumn("trade_date", F.date_add(F.lit("2021-06-01").cast("date"), F.col("d"))).withColumn("session_id", F.concat_ws("|", "symbol", "session_key", "d")).drop("d")


def test_tallies_answer_as_the_rows_do(spark, tmp_path):
    rows = features_of(spark, 3)
    asked = [Preset("green", catalog.Outcome("true", "green", "ret_oc_pct")), Preset("up", catalog.Outcome("gap_dir is not null", "green"), "gap_dir = 'up'")]
    store = str(tmp_path / "store")
    assert tallies.refresh(rows, asked, store).count() == 6
    for today in ("2021-06-09", "2022-01-01", "2022-12-31", "2023-03-05", None):
        before = rows.select("symbol", "session_key").distinct().withColumn("today", F.lit(today).cast("date"))
        got = tallies.answered(tallies.read(spark, store), before, last=100, warn=5, refuse=2)
        hits = envelope.matched(rows.filter("true" if today is None else f"trade_date < date '{today}'"), asked)
        want = envelope.counted(hits, envelope.KEYS, warn=5, refuse=2).join(envelope.stability(hits), envelope.KEYS).join(envelope.recency(hits, 100).select(*envelope.KEYS, "n_recent", "k_recent", "diverges").withColumnsRenamed({"n_recent": "r", "k_recent": "kr", "diverges": "d"}), envelope.KEYS, "left")
        both = got.join(want.withColumnsRenamed({c: f"w_{c}" for c in want.columns if c not in envelope.KEYS}), envelope.KEYS).collect()
        assert len(both) == 12 == want.count()
        for r in both:
            assert all(r[c] == r[f"w_{c}"] for c in ("n", "k", "estimate", "ci_low", "ci_high", "low_sample", "refused", "n1", "k1", "n2", "k2", "agree"))
            assert r.w_r is None or (r.n_recent, r.k_recent, r.diverges) == (r.w_r, r.w_kr, r.w_d)
    # Only a changed series is asked again; what it gives is as if all had been.
    more = rows.unionByName(rows.filter("symbol = 'B' and session_key = 'y' and trade_date = date '2023-01-05'").withColumn("trade_date", F.lit("2024-01-05").cast("date")))
    again = tallies.refresh(more, asked, store)
    assert [tuple(r) for r in again.collect()] == [("B", "y")]
    order = [*envelope.KEYS, "year"]
    assert tallies.by_year(tallies.read(spark, store)).orderBy(order).collect() == tallies.by_year(tallies.tally(more, asked)).orderBy(order).collect()
    assert tallies.refresh(more, asked, store).count() == 0


def test_sketches_are_near_the_quantiles(spark):
    rows = features_of(spark, 8, 2500)
    asked = [Preset("ret", catalog.Outcome("true", "green", "ret_oc_pct")), Preset("none", catalog.Outcome("true", "green"))]
    got = {(r.qid, r.symbol, r.session_key): r for r in tallies.quantiles(tallies.tally(rows, asked)).collect()}
    values = {}
    for r in rows.filter("complete").collect():
        values.setdefault((r.symbol, r.session_key), []).append(r.ret_oc_pct)
    for (s, k), own in values.items():
        q = got["ret", s, k]
        assert q["count"] == len(own) and (q["min"], q["max"]) == (min(own), max(own))
        for name, rank in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)):
            assert abs(sum(v <= q[name] for v in own) / len(own) - rank) < 0.02
        assert got["none", s, k]["count"] == 0 and got["none", s, k].median is None


def test_streamed_bars_order_ticks_within_a_millisecond(spark, tmp_path):
    """The earlier of two ticks in one millisecond opens, the later closes, as in the SQL, whichever is higher."""
    at = "timestamp_ntz '2024-01-02 10:00:00.000"
    # Each event of even id moves the price up, each of odd id down.
    rows = [(2, "100", "click"), (1, "900", "click"), (3, "050", "view"), (4, "950", "view")]
    events = " union all ".join(f"select {i}L as event_id, {at}{us}' as ts, '{kind}' as event_type, 10.0D as value" for i, us, kind in rows)
    spark.sql(events).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = {(r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in queries.QUERIES["stream_bars"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(queries.SQL["stream_bars"]).fetchall())
    assert {(x[0], x[2] > x[5]) for x in got} == {("click", True), ("view", False)}


def test_zones_do_not_depend_on_the_blocks_they_are_folded_by(spark, monkeypatch):
    """A zone lives on from one block of sessions to the next, and of too many the oldest goes."""
    pick, rows, price = random.Random(4), [], 100.0
    for k in range(60):
        price += pick.choice([-3.0, -1.0, 1.0, 3.0])
        rows.append(("A", "x", k, price, price + 1.0, price - 1.0))
    frame = spark.createDataFrame(rows, "symbol string, session_key string, k int, open double, high double, low double").withColumn("trade_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k"))).drop("k")
    zones, want = [], []
    for k, (*_, opened, high, low) in enumerate(rows):
        want.append((any(not bull and lo > opened for lo, hi, bull in zones), any(bull and hi < opened for lo, hi, bull in zones)))
        zones = [z for z in zones if not (low <= z[0] if z[2] else high >= z[1])]
        if k > 1 and low > rows[k - 2][4]:
            zones.append((rows[k - 2][4], low, True))
        elif k > 1 and high < rows[k - 2][5]:
            zones.append((high, rows[k - 2][5], False))
        zones = zones[-3:]
    for size in (1, 7, 60, 128):
        monkeypatch.setattr(derive, "FOLDED", size)
        assert [tuple(r) for r in derive.gap_zones(frame, 3).orderBy("trade_date").select("fvg_above", "fvg_below").collect()] == want
    assert len(set(want)) > 2
