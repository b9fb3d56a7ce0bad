"""Scans by blocks, bars stored together, files of many symbols."""

import random

import pytest
from barometry.operators import calendars, derive, partials, scans, trades
from barometry.sources import readers
from pyspark.sql import functions as F


def rows_of(spark, n, seed):
    pick = random.Random(seed)
    rows = [(pick.choice("AAAAAAB"), i, pick.choice([None, None, f"v{i}"]), float(pick.randrange(5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at long, v string, q double").withColumn("block", F.expr("at div 10"))


@pytest.mark.parametrize("seed", range(2))
def test_blocks_give_what_whole_windows_give(spark, seed):
    rows, frame = rows_of(spark, 300, seed)
    sums, seen = {}, {}
    for k, at, _, q in rows:
        seen[k] = seen.get(k, 0.0) + q
        sums[at] = seen[k]
    got = scans.running_sum(frame, ["k"], "block", ["at"], "q", "s")
    assert {r.at: r.s for r in got.collect()} == sums
    for inclusive in (False, True):
        want, ahead = {}, {}
        for k, at, v, _ in reversed(rows):
            want[at] = v if inclusive and v else ahead.get(k)
            ahead[k] = v or ahead.get(k)
        got = scans.next_known(frame, ["k"], "block", [F.col("at")], ["v"], inclusive)
        assert {r.at: r.next_v for r in got.collect()} == want
    last, want = {}, {}
    for k, at, _, _ in rows:
        want[at], last[k] = last.get(k), at
    assert {r.at: r.last_at for r in scans.last_before(frame, ["k"], "block", "at").collect()} == want


def test_one_symbols_fills_are_many_tasks(spark, capsys):
    """The same result by blocks of any size, and no window over a whole symbol's fills."""
    pick = random.Random(4)
    fills = [(i, "A", pick.choice(["buy", "sell"]), float(pick.randrange(1, 4)), float(pick.randrange(90, 110)), 0.25, i * 7_000_000, f"d{i // 50}") for i in range(3000)]
    frame = spark.createDataFrame(fills, "fill_id long, symbol string, side string, quantity double, price double, fee double, ts long, trade_date string")
    total = lambda size: {r.trade_date: round(r.p, 6) for r in trades.realised(frame, block_marks=size).groupBy("trade_date").agg(F.sum("pnl").alias("p")).collect()}
    assert total(50) == total(10**9) and len(total(50)) > 10
    trades.realised(frame, block_marks=50).explain()
    plan = [x for x in capsys.readouterr().out.splitlines() if "Window [" in x]
    # Windows over whole keys read one row a block.
    assert len(plan) >= 4 and all("block" in x for x in plan)
    marks = frame.withColumn("block", F.expr(f"ts div {trades.BLOCK_MS}"))
    spread = scans.running_sum(marks, ["symbol", "side"], "block", ["ts"], "quantity", "upto").repartition(8, "symbol", "side", "block").withColumn("p", F.spark_partition_id())
    assert spread.select("p").distinct().count() == 8


def test_bars_stored_together_are_not_shuffled(spark, tmp_path, capsys):
    rows = [(s, d * 86_400_000 + h * 3_600_000, 100.0 + h, 101.0 + h + d, 99.0 - d, 100.5 + h, 1.0, None) for s in "AB" for d in range(6) for h in range(24)]
    bars = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double, contract string")
    windows = calendars.session_windows(calendars.spans(bars), spark.createDataFrame([("late", 1080, 1020, "America/New_York", True, True)], calendars.DEFS))
    calendars.keep_together(bars, windows, "held", str(tmp_path / "held"), 8)
    parts = partials.partials(calendars.assign_together(spark, "held"), within=("day",))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = derive.session_stats(calendars.assign(bars, windows))
    want = derive.stats_of_parts(partials.merged(parts))
    order = [*partials.KEYS]
    assert got.orderBy(order).select(sorted(got.columns)).collect() == want.orderBy(order).select(sorted(got.columns)).collect() != []


def test_files_of_many_symbols_are_one_scan(spark, tmp_path, capsys):
    names = [*(f"S{i}" for i in range(40)), "BRK.B", "EUR+USD", "a b"]
    frame = spark.createDataFrame([(n, 1_700_000_040_000 + 60_000 * t, 1.0, 2.0, 0.5, 1.5, 3.0) for n in names for t in range(3)], "symbol string, ts long, open double, high double, low double, close double, volume double")
    for kind, read, rows in (
        ("csv", readers.read_ohlcv_csv_ns, frame.selectExpr("symbol", "ts * 1000000 as ts_event", "open", "high", "low", "close", "volume")),
        ("text", readers.read_candle_short_json, frame.groupBy("symbol").agg(F.to_json(F.collect_list(F.struct(F.col("ts").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v")))).alias("value"))),
    ):
        place = str(tmp_path / kind)
        rows.write.option("header", "true").partitionBy("symbol").format(kind).save(place)
        got = readers.checked(read(spark, f"{place}/symbol=*", readers.in_path()))
        got.explain()
        plan = capsys.readouterr().out
        assert plan.count("FileScan") == 1 and "Union" not in plan
        columns = ["symbol", "ts", "open", "high", "low", "close", "volume"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, frame.select(columns).collect()))
        # One symbol's file by name, as before.
        one = read(spark, f"{place}/symbol=S7", "S7")
        assert one.count() == 3 and {r.symbol for r in one.collect()} == {"S7"}
