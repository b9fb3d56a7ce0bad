"""Executed trades: fills dated by session, matched first in first out, and day tags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS
from ..sources.store import kept
from . import scans

#: A symbol's fills are dealt to tasks by spans of so many ms, and its matches by about so many units' marks.
BLOCK_MS, BLOCK_MARKS = DAY_MS // 24, 1 << 16


def dated(fills: DataFrame, windows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """fills with store_symbol, trade_date (of the symbol's first window that ends after the fill) and skipped (unmapped, no_time, out_of_range or null).

    fills: fill_id, symbol, ts (ms). mapping: symbol, store_symbol; others keep their name.
    windows: symbol, trade_date, end_ts. An as-of join by sorting, in blocks of time, and no range join.
    """
    named = fills.withColumn("store_symbol", F.col("symbol")) if mapping is None else fills.join(mapping, "symbol", "left").withColumn("store_symbol", F.coalesce("store_symbol", "symbol"))
    known = windows.select(F.col("symbol").alias("store_symbol")).distinct().withColumn("known", F.lit(True))
    rows = named.join(known, "store_symbol", "left")
    ends = windows.groupBy(F.col("symbol").alias("store_symbol"), F.col("end_ts").alias("at")).agg(F.min("trade_date").alias("date"))
    # Ends sort before fills of the same time: a window that ends at the fill is over.
    both = ends.withColumn("kind", F.lit(0)).unionByName(rows.filter("ts is not null and known").select("store_symbol", F.col("ts").alias("at"), F.lit(None).cast("date").alias("date"), "fill_id", F.lit(1).alias("kind")), allowMissingColumns=True)
    both = both.withColumn("block", F.call_function("div", F.col("at"), F.lit(BLOCK_MS).cast("long")))
    found = scans.next_known(both, ["store_symbol"], "block", [F.col("at"), F.col("kind")], ["date"]).filter("kind = 1").select("fill_id", F.col("next_date").alias("trade_date"))
    out = rows.join(found, "fill_id", "left")
    return out.withColumn("skipped", F.when(F.col("known").isNull(), "unmapped").when(F.col("ts").isNull(), "no_time").when(F.col("trade_date").isNull(), "out_of_range")).drop("known")


def skips(fills: DataFrame) -> DataFrame:
    """How many of dated()'s fills are used, and how many are skipped for each reason."""
    count = lambda name, cond: F.count(F.when(cond, 1)).alias(name)
    return fills.agg(F.count("*").alias("fills"), count("used", F.col("skipped").isNull()), *(count(r, F.col("skipped") == r) for r in ("unmapped", "no_time", "out_of_range")))


def realised(fills: DataFrame, multiplier: float = 1.0, block_marks: int = BLOCK_MARKS) -> DataFrame:
    """symbol, trade_date and pnl of each first-in-first-out match, booked on the closing fill's date.

    Units bought and units sold are numbered in time; unit number u of one side meets unit
    number u of the other. So matches are overlaps of two cumulative ranges: all range ends
    of a symbol are sorted, and the fill that holds each piece is the next one on its side.
    Both scans go by blocks, so that one symbol's fills are many tasks.
    """
    sides = fills.filter(F.col("side").isin("buy", "sell") & (F.col("quantity") > 0)).withColumn("block", F.coalesce(F.call_function("div", F.col("ts"), F.lit(BLOCK_MS).cast("long")), F.lit(-(2**62))))
    # Each scan reads its rows twice, once to sum up the blocks; tables of their own keep that from being the whole history twice.
    ranked = scans.running_sum(kept(sides, "sides"), ["symbol", "side"], "block", ["ts", "fill_id"], "quantity", "upto")
    unit = F.struct("ts", "fill_id", "price", (F.coalesce("fee", F.lit(0.0)) / F.col("quantity")).alias("fee"), "trade_date")
    marks = ranked.groupBy("symbol", "upto").agg(F.max(F.when(F.col("side") == "buy", unit)).alias("b"), F.max(F.when(F.col("side") == "sell", unit)).alias("s"))
    dealt = scans.value_blocks(kept(marks, "marks"), ["symbol"], "upto", block_marks, "block")
    ahead = scans.next_known(dealt, ["symbol"], "block", [F.col("upto")], ["b", "s"], inclusive=True)
    # What a piece's units are: its end less the end before it, in the block or in those before.
    before = scans.last_before(ahead, ["symbol"], "block", "upto")
    pieces = before.select("symbol", (F.col("upto") - F.coalesce("last_upto", F.lit(0.0))).alias("q"), F.col("next_b").alias("b"), F.col("next_s").alias("s")).filter("b is not null and s is not null")
    net = (F.col("s.price") - F.col("b.price")) * F.col("q") * multiplier - (F.col("b.fee") + F.col("s.fee")) * F.col("q")
    return pieces.select("symbol", F.when(F.struct("b.ts", "b.fill_id") > F.struct("s.ts", "s.fill_id"), F.col("b.trade_date")).otherwise(F.col("s.trade_date")).alias("trade_date"), net.alias("pnl"))


def day_results(fills: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """trade_date, pnl (null: nothing closed) and fills over all symbols."""
    days = fills.filter("trade_date is not null").groupBy("trade_date").agg(F.count("*").alias("fills"))
    return days.join(realised(fills, multiplier).groupBy("trade_date").agg(F.sum("pnl").alias("pnl")), "trade_date", "left")


def tags(days: DataFrame) -> DataFrame:
    """(date, event) rows TRADED, and TRADED_WIN or TRADED_LOSS by the sign of the day's result."""
    win = F.when(F.col("pnl") > 0, "TRADED_WIN").when(F.col("pnl") < 0, "TRADED_LOSS")
    return days.select(F.col("trade_date").alias("date"), F.explode(F.array_compact(F.array(F.lit("TRADED"), win))).alias("event"))


def tag_summary(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event").isin("TRADED", "TRADED_WIN", "TRADED_LOSS")).groupBy("event").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
