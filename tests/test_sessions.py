"""Calendars, features, statistics, trades, alerts and readers on small tables of their own."""

import gzip
import json
import random

import pytest
from barometry.functions import stats
from barometry.functions.scalars import epoch_ms, rounded
from barometry.functions.stats import estimate
from barometry.operators import calendars, derive, ingest, lookups, trades
from barometry.plans import catalog, envelope
from barometry.plans.catalog import Preset
from barometry.sources import readers, sinks
from barometry.streaming import monitor
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
NY = ("rth", 570, 960, "America/New_York", False, False)


def days(spark, symbol, first, last):
    return spark.createDataFrame([(symbol, first, last)], "symbol string, first string, last string").select("symbol", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


def utc(row):
    from datetime import UTC, datetime

    return tuple(datetime.fromtimestamp(x / 1000, UTC).strftime("%Y-%m-%dT%H:%M") for x in (row.start_ts, row.end_ts))


def windows(spark, first, last, *defs, **more):
    found = calendars.session_windows(days(spark, "A", first, last), spark.createDataFrame(list(defs), calendars.DEFS), **more)
    return {str(r.trade_date): r for r in found.collect()}


def test_daylight_saving_and_weekends(spark):
    got = windows(spark, "2024-03-08", "2024-03-11", NY)
    assert utc(got["2024-03-08"]) == ("2024-03-08T14:30", "2024-03-08T21:00")
    assert utc(got["2024-03-11"]) == ("2024-03-11T13:30", "2024-03-11T20:00") and len(got) == 2
    autumn = windows(spark, "2024-11-01", "2024-11-04", NY)
    assert utc(autumn["2024-11-04"]) == ("2024-11-04T14:30", "2024-11-04T21:00")


def test_overnight_holidays_half_days_and_midnight(spark):
    overnight = ("globex", 1080, 1020, "America/New_York", True, False)
    assert utc(windows(spark, "2024-01-08", "2024-01-08", overnight)["2024-01-08"]) == ("2024-01-07T23:00", "2024-01-08T22:00")
    assert utc(windows(spark, "2024-01-06", "2024-01-06", ("utc", 0, 1440, "UTC", False, True))["2024-01-06"]) == ("2024-01-06T00:00", "2024-01-07T00:00")
    date = lambda *rows: spark.createDataFrame(list(rows), "date string, close_min int").withColumn("date", F.to_date("date"))
    got = windows(spark, "2024-11-27", "2024-11-29", NY, holidays=date(("2024-11-28", None)), half_days=date(("2024-11-29", 780), ("2024-11-27", 1200)))
    assert set(got) == {"2024-11-27", "2024-11-29"} and utc(got["2024-11-29"])[1] == "2024-11-29T18:00"
    assert got["2024-11-27"].is_half_day and utc(got["2024-11-27"])[1] == "2024-11-27T21:00"


def test_definitions_override(spark):
    rows = {r.session_key: r for r in calendars.definitions(spark, "CME", [("rth", 500, 900, "UTC", False, False)]).collect()}
    assert rows["rth"].start_min == 500 and rows["globex"].overnight


def test_epoch_units_are_exact(spark):
    text = ["1704067200", "1704067200123", "1704067200123456", "1704067200123456789", "99999999999", "100000000000"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(epoch_ms(F.col("t"))).collect()]
    assert got == [1704067200000, 1704067200123, 1704067200123, 1704067200123, 99999999999000, 100000000000]


def test_wilson_and_guards(spark):
    counts = spark.createDataFrame([(10, 5), (10, 0), (0, 0), (30, 24)], "n long, k long")
    got = [tuple(r) for r in counts.select(*estimate("n", "k")).collect()]
    assert got[0] == (0.5, 0.2366, 0.7634) and got[1][:2] == (0.0, 0.0) and got[2] == (None, None, None)
    assert tuple(round(x, 3) for x in got[3]) == (0.8, 0.627, 0.905)
    hits = spark.createDataFrame([("q", "A", "k", i % 2 == 0) for i in range(9)] + [("q", "B", "k", True)] * 29 + [("q", "C", "k", True)] * 30, "qid string, symbol string, session_key string, success boolean")
    rows = {r.symbol: r for r in envelope.counted(hits, envelope.KEYS).collect()}
    assert rows["A"].refused and rows["A"].estimate is None and rows["A"].k == 5
    assert rows["B"].low_sample and not rows["B"].refused and not rows["C"].low_sample
    assert envelope.counted(hits, envelope.KEYS, force=True).filter("symbol = 'A'").first().estimate == 0.5556
    assert spark.range(1).select(rounded(F.lit(-0.0000005), 6)).first()[0] == 0.0


def series(spark, ohlc, contracts=None):
    """One bar-built session of 2 hours a day from (open, high, low, close): the first bar opens, the last closes."""
    rows = []
    for i, (o, h, low, c) in enumerate(ohlc):
        contract = contracts[i] if contracts else None
        rows += [("A", i * DAY, o, max(o, h), o, o, 1.0, contract), ("A", i * DAY + HOUR, o, max(h, c), min(low, c), c, 1.0, contract)]
    bars = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double, contract string")
    defs = spark.createDataFrame([("utc", 0, 120, "UTC", False, True)], calendars.DEFS)
    return derive.features(calendars.assign(bars, calendars.session_windows(calendars.spans(bars), defs)), HOUR)


def test_gaps_levels_and_rolls(spark):
    got = series(spark, [(100.0, 101.0, 99.0, 100.0), (101.0, 102.0, 99.5, 101.5), (101.0, 101.2, 100.8, 101.0), (105.0, 106.0, 104.0, 105.5)], ["F", "F", "F", "G"]).orderBy("trade_date").collect()
    assert got[0].gap_dir is None and got[1].gap_dir == "up" and got[1].gap_filled and got[1].gap_fill_min == 60
    assert got[1].gap_pct == 1.0 and got[1].gap_bucket == "l" and not got[1].gap_reversed and got[1].touched_prev_high
    assert got[2].gap_dir == "down" and not got[2].gap_filled and got[2].inside_day
    assert got[3].is_roll_day and got[3].prev_close is None and got[3].gap_dir is None and got[3].prev_day_green is False
    assert [r.prev_green_streak for r in got] == [0, 0, 1, 0] and got[2].next_green and all(r.complete for r in got)


def test_zones_equal_a_plain_walk(spark):
    rng = random.Random(6)
    price, ohlc = 100.0, []
    for _ in range(90):
        o = price + rng.uniform(-2, 2)
        c = o + rng.uniform(-2, 2)
        ohlc.append((o, max(o, c) + rng.random(), min(o, c) - rng.random(), c))
        price = c
    got = series(spark, ohlc).orderBy("trade_date").collect()
    for i, r in enumerate(got):
        live = []
        for f in range(2, i):
            a, b = got[f - 2], got[f]
            if b.low > a.high and not any(x.low <= a.high for x in got[f + 1 : i]):
                live.append(("below", b.low))
            if b.high < a.low and not any(x.high >= a.low for x in got[f + 1 : i]):
                live.append(("above", b.high))
        assert r.fvg_below == any(k == "below" and x < r.open for k, x in live)
        assert r.fvg_above == any(k == "above" and x > r.open for k, x in live)


def test_conditions_treat_null_as_false(spark):
    rows = series(spark, [(100.0, 101.0, 99.0, 100.5 + 0.1 * i) for i in range(6)])
    ask = lambda where: envelope.counted(envelope.matched(rows, [Preset("q", catalog.close_green(), where)]), envelope.KEYS, refuse=1).first().n
    n, yes, no = ask("true"), ask(catalog.gap_side("down")), ask(catalog.negated(catalog.gap_side("down")))
    assert n == 6 and yes + no == 6 and no >= 1


def fifo(fills):
    """Plain queue of open lots."""
    lots, out = [], {}
    for f in fills:
        sign, left = (1 if f[2] == "buy" else -1), f[3]
        while left and lots and lots[0][0] == -sign:
            q = min(left, lots[0][1])
            pnl = (f[4] - lots[0][2]) * -sign * q - (lots[0][3] + f[5] / f[3]) * q
            out[f[7]] = out.get(f[7], 0) + pnl
            lots[0][1] -= q
            left -= q
            if not lots[0][1]:
                lots.pop(0)
        if left:
            lots.append([sign, left, f[4], f[5] / f[3]])
    return {k: round(v, 6) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_realised_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    fills = [(i, "A", rng.choice(["buy", "sell"]), rng.randrange(1, 6), float(rng.randrange(90, 110)), 0.5, i // 2, f"d{i // 7}") for i in range(120)]
    frame = spark.createDataFrame(fills, "fill_id long, symbol string, side string, quantity long, price double, fee double, ts long, trade_date string")
    got = {r.trade_date: round(r.pnl, 6) for r in trades.realised(frame).groupBy("trade_date").agg(F.sum("pnl").alias("pnl")).collect()}
    assert got == fifo(fills)


def test_fills_are_dated_forward(spark):
    frame = spark.createDataFrame([(1, "x", 5), (2, "x", 10), (3, "x", 25), (4, "y", 5), (5, "x", None), (6, "a", 1)], "fill_id long, symbol string, ts long")
    wins = spark.createDataFrame([("S", "d1", 10), ("S", "d2", 20), ("a", "d9", 3)], "symbol string, trade_date string, end_ts long").withColumn("trade_date", F.to_date(F.concat(F.lit("2024-01-0"), F.substring("trade_date", 2, 1))))
    got = {r.fill_id: (str(r.trade_date), r.skipped) for r in trades.dated(frame, wins, spark.createDataFrame([("x", "S")], "symbol string, store_symbol string")).collect()}
    assert got[1] == ("2024-01-01", None) and got[2] == ("2024-01-02", None) and got[3][1] == "out_of_range" and got[4][1] == "unmapped" and got[5][1] == "no_time" and got[6] == ("2024-01-09", None)


def test_store_round_trip(spark, tmp_path):
    bars = spark.createDataFrame([("A", "1h", 1704067200000 + i * HOUR, 1.0, 2.0, 0.5, 1.5, 1.0, None) for i in range(5)], "symbol string, tf string, ts long, open double, high double, low double, close double, volume double, contract string")
    path = str(tmp_path / "store")
    assert readers.read_bars(spark, path).count() == 0
    ingest.append(bars.limit(3), path)
    ingest.append(bars, path, ingest.watermarks(readers.read_bars(spark, path)))
    stored = readers.read_bars(spark, path)
    assert stored.count() == 5 and stored.select("ts").distinct().count() == 5
    assert readers.read_partition(spark, path, "A", "1h", [2024]).count() == 5 and readers.read_partition(spark, path, "A", "1h", [2023]).count() == 0
    ingest.resync(bars.withColumn("close", F.lit(9.0)).limit(2), path)
    assert readers.read_bars(spark, path).count() == 2
    with pytest.raises(Exception, match="more than 1 bars"):
        rows = bars.select("*", F.lit("k").alias("session_key"), F.lit(1).alias("trade_date"))
        lookups.session_bars(rows, F.lit(True), cap=1).collect()


def put(path, text):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())
    return str(path)


def test_bar_readers(spark, tmp_path):
    ms = 1704067200000
    bar = (ms, 1.0, 3.0, 0.5, 2.0)
    one = lambda frame: [(r.ts, r.open, r.high, r.low, r.close) for r in readers.checked(frame).collect()]
    p = lambda name, text: put(tmp_path / name, text)
    assert one(readers.read_csv_bars(spark, p("a.csv", "when;o;h;l;c\n1704067200;1;3;0.5;2\n;1;1;1;1\n1704067201;x;1;1;1\n"), "A", dict(ts="when", open="o", high="h", low="l", close="c"), "s", ";")) == [bar]
    assert one(readers.read_csv_bars(spark, p("b.csv", "t,o,h,l,c\n2024-01-01T00:00:00Z,1,3,0.5,2\n"), "A", dict(ts="t", open="o", high="h", low="l", close="c"), "iso")) == [bar]
    assert one(readers.read_kline_csv(spark, p("k.csv", f"open_time,open,high,low,close,volume,x\n{ms},1,3,0.5,2,7,9\n{ms}000,1,3,0.5,2,7,9\n"), "A")) == [bar, bar]
    assert one(readers.read_kline_json(spark, p("k.json", json.dumps([[ms, "1", "3", "0.5", "2", "7", 1]])), "A")) == [bar]
    assert one(readers.read_candles_json(spark, p("c.json", json.dumps([[ms // 1000, 0.5, 3, 1, 2, 7]])), "A")) == [bar]
    assert one(readers.read_bars_page_json(spark, p("pages/1.json", json.dumps({"bars": [{"t": "2024-01-01T00:00:00Z", "o": 1, "h": 3, "l": 0.5, "c": 2, "v": 7}], "next_page_token": None})), "A")) == [bar]
    assert one(readers.read_bars_page_json(spark, p("pages/2.json", '{"bars": null}'), "A")) == []
    got = readers.read_ohlcv_csv_ns(spark, p("n.csv", f"ts_event,open,high,low,close,volume,symbol\n{ms}000000,1,3,0.5,2,7,ESH4\n"), "ES")
    assert one(got) == [bar] and got.first().contract == "ESH4"
    flat = readers.read_flat_minutes(spark, p("f.csv.gz", f"Ticker,Window_Start,open,high,low,close,v\nA,{ms}000000,1,3,0.5,2,7\nB,{ms}000000,1,3,0.5,2,7\n"))
    assert one(flat.filter("symbol = 'B'")) == [bar] and flat.count() == 2 and flat.first().volume == 7
    objects = json.dumps([{"ts": ms, "open": 1, "high": 3, "low": 0.5, "close": 2}, {"timestamp": "2024-01-01T00:00:00Z", "open": 1, "high": 3, "low": 0.5, "close": 2, "volume": 1}])
    assert one(readers.read_candle_objects_json(spark, p("o.json", objects), "A")) == [bar, bar] == one(readers.read_rates_json(spark, p("o.json", objects), "A"))
    assert one(readers.read_candle_short_json(spark, p("s.json", json.dumps([{"t": ms, "o": "1", "h": "3", "l": "0.5", "c": "2", "v": "7"}, {"t": ms, "o": "NaN", "h": "3", "l": "0.5", "c": "2", "v": "7"}])), "A")) == [bar]
    assert readers.quarantined(readers.read_candle_short_json(spark, str(tmp_path / "s.json"), "A")).count() == 1


def test_calendar_event_and_fill_readers(spark, tmp_path):
    cal = {"exchange": "X", "version": "1", "holidays": [{"date": "2024-01-01", "name": "New Year"}], "halfDays": [{"date": "2024-07-03", "name": "Eve", "close": "13:00"}]}
    holidays, half = readers.read_calendar(spark, put(tmp_path / "cal/x.json", json.dumps(cal, indent=1)))
    assert holidays.count() == 1 and half.first().close_min == 780
    put(tmp_path / "ev/a.json", json.dumps({"event": "CPI", "dates": ["2024-01-11", "2024-02-13"]}, indent=1))
    put(tmp_path / "ev/b.json", json.dumps({"event": "NFP", "dates": ["2024-01-05"]}))
    assert sorted((str(r.date), r.event) for r in readers.read_events(spark, str(tmp_path / "ev")).collect()) == [("2024-01-05", "NFP"), ("2024-01-11", "CPI"), ("2024-02-13", "CPI")]
    fills = readers.read_fills_csv(spark, put(tmp_path / "fills.csv", "symbol,side,quantity,price,fee,executedAt\nA,BUY,2,1.5,,2024-01-01T00:00:00Z\nA,hold,1,1,,\nA,sell,-1,1,,\nB,sell,1,x,,\n"))
    rows = fills.filter("ok").collect()
    assert fills.count() == 4 and [(r.side, r.quantity, r.ts) for r in rows] == [("buy", 2.0, 1704067200000)]


def test_sinks(spark, tmp_path):
    rows = series(spark, [(100.0, 101.0, 99.0, 100.5), (101.0, 102.0, 99.5, 101.5)])
    out = lambda name: str(tmp_path / name)
    sinks.replace_features(rows, out("f"))
    sinks.replace_features(rows.limit(1), out("f"))
    assert spark.read.parquet(out("f")).count() == 1
    sinks.export(rows.select("symbol", "open"), out("e"), symbols=["B"])
    assert spark.read.option("header", True).csv(out("e")).count() == 0
    hits = envelope.matched(rows, [Preset("q", catalog.close_green())])
    sinks.export_matches(rows, hits, out("m"), "parquet")
    assert {"outcome_success", "outcome_value"} <= set(spark.read.parquet(out("m")).columns)
    sinks.sweep_artefacts(rows, [Preset("q", catalog.close_green())], out("s"))
    assert spark.read.json(out("s/results")).first().n == 2 and spark.read.json(out("s/manifest")).first().sessions == 2
    tags = trades.tags(spark.createDataFrame([(1, 2.0), (2, -1.0), (3, None)], "d int, pnl double").select(F.date_from_unix_date("d").alias("trade_date"), "pnl"))
    sinks.replace_tags(tags, out("t"))
    sinks.replace_tags(tags.filter("event = 'TRADED_WIN'"), out("t"))
    assert spark.read.parquet(out("t")).count() == 5


def test_developing_features_equal_those_of_the_whole_series(spark):
    days = [(100.0 + i % 5, 103.0 + i % 7, 98.0 - i % 3, 101.0 + i % 4) for i in range(24)]
    bars = spark.createDataFrame([("A", d * DAY + h * HOUR, o, hi, lo, c, 1.0, "Z4" if d < 12 else "H5") for d, (o, hi, lo, c) in enumerate(days) for h in range(24)], "symbol string, ts long, open double, high double, low double, close double, volume double, contract string")
    defs = spark.createDataFrame([("utc", 0, 1440, "UTC", False, True)], calendars.DEFS)
    assigned = calendars.assign(bars, calendars.session_windows(calendars.spans(bars), defs))
    for day, until in ((23, 9), (12, 3)):
        seen = assigned.filter((F.col("ts") < day * DAY + until * HOUR))
        whole = derive.features(seen, HOUR).filter(F.col("start_ts") == day * DAY)
        own = derive.own_features(assigned.filter(F.col("start_ts") < day * DAY))
        live = derive.developing_features(own, seen.filter(F.col("start_ts") == day * DAY), HOUR)
        assert live.select(sorted(live.columns)).collect() == whole.select(sorted(whole.columns)).collect() != []


def test_presets_check_their_parameters():
    assert catalog.preset("gap-fill", dir="up", min_gap_pct=0.5).where == "(true) and (abs_gap_pct >= 0.5) and (gap_dir = 'up')"
    assert catalog.preset("day-before-event", event="CPI").where == "(next_ev_cpi)"
    for bad in ({"name": "nothing"}, {"name": "green-rate", "n": 3}, {"name": "orb", "dir": "sideways"}, {"name": "orb", "window": "long"}, {"name": "range-vs-atr", "r": float("nan")}):
        with pytest.raises(ValueError):
            catalog.preset(**bad)


def test_symbol_definitions_and_defaults(spark):
    symbols = spark.createDataFrame([("A", "equity", None), ("B", "forex", None), ("C", "equity", "CRYPTO"), ("D", "art", None)], "symbol string, asset_class string, exchange string")
    over = spark.createDataFrame([("A", "rth", 480, 900, "UTC", False, False), ("A", "own", 1, 2, "UTC", False, True)], f"symbol string, {calendars.DEFS}")
    got = {(r.symbol, r.session_key): r.start_min for r in calendars.symbol_definitions(symbols, over).collect()}
    assert got == {("A", "rth"): 480, ("A", "own"): 1, ("B", "sydney"): 1260, ("B", "tokyo"): 0, ("B", "london"): 420, ("B", "newyork"): 720, ("C", "utc"): 0, ("C", "ny"): 570}
    assert {r.symbol: r.default_session for r in calendars.with_defaults(symbols).collect()} == {"A": "rth", "B": "london", "C": "rth", "D": None}


def test_calendar_hash_ignores_order_and_files_must_agree(spark, tmp_path):
    stamp = spark.createDataFrame([("abc",)], "fingerprint string")
    days = spark.createDataFrame([("X", "2024-01-01"), ("X", "2024-07-04")], "exchange string, date string")
    told = lambda c: tuple(lookups.provenance(stamp, c, "1", {"outcome": "gapFill"}).first())
    assert told(days) == told(days.orderBy("date", ascending=False).repartition(2)) != told(days.limit(1))
    put(tmp_path / "csv/a.csv", "t,o,h,l,c\n1704067200000,1,3,0.5,2\n")
    put(tmp_path / "csv/b.csv", "t,h,o,l,c\n1704067200000,3,1,0.5,2\n")
    mapping = {"ts": "t", "open": "o", "high": "h", "low": "l", "close": "c"}
    with pytest.raises(Exception, match="(?i)header|column"):
        readers.read_csv_bars(spark, str(tmp_path / "csv"), "A", mapping).collect()


def test_impossible_counts_are_errors(spark):
    with pytest.raises(Exception, match="from 0 to the number of trials"):
        spark.createDataFrame([(3, 4)], "n long, k long").select(*stats.wilson(F.col("n"), F.col("k"))).collect()


def test_listed_matches_are_bounded(spark):
    days = [(i, "q", "A", "s", f"A|s|{i}", 600) for i in range(1, 601)]
    hits = spark.createDataFrame(days, "rn long, qid string, symbol string, session_key string, session_id string, total long").withColumns({"trade_date": F.current_date(), "success": F.lit(True), "value": F.lit(1.0)})
    assert [envelope.latest(hits, n).count() for n in (0, -3, 2, 500, 501)] == [0, 0, 2, 500, 500]


def test_windows_of_many_definitions(spark):
    defs = spark.createDataFrame([(f"k{i}", i % 600, 600 + i % 600, "UTC", False, i % 2 == 0) for i in range(1501)], calendars.DEFS)
    symbols = spark.sql("select 's' as symbol, date'2024-03-01' as first, date'2024-03-02' as last")
    got = calendars.session_windows(symbols, defs).groupBy("trade_date").count().orderBy("trade_date").collect()
    assert [r["count"] for r in got] == [1501, 751]
