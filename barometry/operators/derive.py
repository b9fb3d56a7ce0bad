"""One wide feature row per symbol, session key and trade date."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE_MS, gap_bucket, minutes_since, percent, rounded
from . import partials
from .partials import KEYS, OR_WINDOWS

IB_WINDOW = 60
MAX_ZONES = 60


def in_series() -> WindowSpec:
    """A series' sessions in order; built when asked for, as windows need a session of Spark's."""
    return Window.partitionBy("symbol", "session_key").orderBy("trade_date")


def _opens_after_roll(first: Column, last: Column, before: Column) -> Column:
    """Whether the contract changed since the session before, or inside this one."""
    return F.coalesce(first != before, F.lit(False)) | F.coalesce(first != last, F.lit(False))


def prior_levels(sessions: DataFrame) -> dict[str, Column]:
    """The columns that tell the prior session's close, high and low (lag_...), unless the contract rolls between."""
    rolled = _opens_after_roll(F.col("contract_first"), F.col("contract_last"), _lag("contract_last"))
    known = ~rolled & (_lag("close") != 0)
    return {f"lag_{x}": F.when(known, _lag(x)) for x in ("close", "high", "low")}


def session_stats(assigned: DataFrame, windows: tuple[int, ...] = OR_WINDOWS) -> DataFrame:
    """Aggregates of each session's bars, with each opening range's levels, breaks and extremes and the first bars at the prior session's levels. Bars are read, shuffled and sorted once."""
    return stats_of_parts(partials.partials(assigned, windows), windows)


def stats_of_parts(parts: DataFrame, windows: tuple[int, ...] = OR_WINDOWS) -> DataFrame:
    """session_stats() from whole sessions' parts, of whole series."""
    own = partials.sessions(parts)
    return partials.stats(own.withColumns(prior_levels(own)), windows).drop("lag_close", "lag_high", "lag_low")


def opening_ranges(stats: DataFrame, windows: tuple[int, ...] = OR_WINDOWS, ib: int = IB_WINDOW) -> DataFrame:
    """stats with or<w>_ columns and ib_break; null where the range has no bars or none follows."""
    made: dict[str, Column] = {}
    for w in windows:
        up, dn, high, low = (F.col(f"{k}{w}") for k in ("up", "dn", "h", "l"))
        valid = (F.col(f"bars{w}") > 0) & (F.col("bar_count") > F.col(f"bars{w}"))
        first = F.when(up.isNotNull() & (dn.isNull() | (up <= dn)), "up").when(dn.isNotNull(), "down").otherwise("none")
        at = F.when(first == "up", up).when(first == "down", dn)
        extent = lambda broke, past: F.when(broke.isNotNull() & (high - low > 0), rounded(F.try_divide(F.greatest(F.lit(0.0), past), high - low), 6))  # noqa: B023,E731
        values = (
            ("high", high),
            ("low", low),
            ("range", high - low),
            ("first_break", first),
            ("break_min", minutes_since(at, F.col("start_ts"))),
            ("false_break", F.when(first == "up", F.col("close") < high).when(first == "down", F.col("close") > low)),
            ("broke_both", up.isNotNull() & dn.isNotNull()),
            ("ext_up_r", extent(up, F.col(f"ph{w}") - high)),
            ("ext_dn_r", extent(dn, low - F.col(f"pl{w}"))),
        )
        made |= {f"or{w}_{name}": F.when(valid, value) for name, value in values}
        if w == ib:
            made["ib_break"] = F.when(valid, F.when(up.isNotNull() & dn.isNotNull(), "double").when(up.isNotNull(), "single_up").when(dn.isNotNull(), "single_down").otherwise("none"))
    return stats.withColumns(made).drop(*(f"{k}{w}" for w in windows for k in ("up", "dn", "h", "l", "ph", "pl", "bars")))


def _lag(name: str) -> Column:
    return F.lag(name).over(in_series())


def cross_session(stats: DataFrame, bar_ms: int) -> DataFrame:
    """stats with everything that looks at earlier sessions of the same key, complete or not."""
    grace = max(2 * bar_ms, 15 * MINUTE_MS)
    out = stats.withColumn("complete", (F.col("first_ts") <= F.col("start_ts") + grace) & (F.col("last_ts") >= F.col("end_ts") - grace - bar_ms))
    out = out.withColumns({f"p_{name}": _lag(name) for name in ("open", "high", "low", "close", "contract_last")})
    out = out.withColumn("has_prev", F.row_number().over(in_series()) > 1)
    roll = F.col("has_prev") & _opens_after_roll(F.col("contract_first"), F.col("contract_last"), F.col("p_contract_last"))
    out = out.withColumn("is_roll_day", roll).withColumn("use_prev", F.col("has_prev") & ~F.col("is_roll_day"))
    out = out.withColumns({f"prev_{name}": F.when(F.col("use_prev"), F.col(f"p_{name}")) for name in ("close", "high", "low")})
    o, h, low, c, pc, ph, pl = (F.col(x) for x in ("open", "high", "low", "close", "prev_close", "prev_high", "prev_low"))
    gap = F.when(pc != 0, o - pc)
    out = out.withColumns({"range_abs": h - low, "green": c > o, "prev_mid": (ph + pl) / 2.0, "prev_range": ph - pl, "gap_abs": gap, "gap_raw": percent(gap, pc), "gap_dir": F.when(gap > 0, "up").when(gap < 0, "down").when(gap == 0, "none")})
    out = out.withColumns({"range_pct": rounded(percent(F.col("range_abs"), o), 6), "ret_oc_pct": rounded(percent(c - o, o), 6), "gap_pct": rounded(F.col("gap_raw"), 6), "abs_gap_pct": rounded(F.abs("gap_raw"), 6), "gap_bucket": F.when(F.col("gap_dir") != "none", gap_bucket(F.abs("gap_raw")))})
    out = out.withColumns({"open_pos_prev_range": F.when(F.col("prev_range") > 0, rounded(F.try_divide(o - pl, F.col("prev_range")), 6)), "open_above_prev_high": o > ph, "open_below_prev_low": o < pl, "closed_above_prev_high": c > ph, "closed_below_prev_low": c < pl})
    use = F.col("use_prev")
    plain = lambda x: F.coalesce(x, F.lit(False))
    out = out.withColumns({"inside_day": F.when(use, (h <= ph) & (low >= pl)), "outside_day": F.when(use, (h > ph) & (low < pl)), "doji": (F.col("range_abs") > 0) & (F.abs(c - o) <= 0.1 * F.col("range_abs"))})
    po, p_close = F.col("p_open"), F.col("p_close")
    out = out.withColumns({"bull_engulf": F.when(use, (p_close < po) & F.col("green") & (o <= p_close) & (c >= po)), "bear_engulf": F.when(use, (p_close > po) & (c <= o) & (o >= p_close) & (c <= po)), "prev_day_green": p_close > po})
    true_range = F.when(pc.isNotNull(), F.greatest(F.col("range_abs"), F.abs(h - pc), F.abs(low - pc))).otherwise(F.col("range_abs"))
    out = out.withColumn("tr", true_range)
    before = lambda n: in_series().rowsBetween(-n, -1)
    full = lambda x, n, f: F.when(F.count(x).over(before(n)) == n, f(x).over(before(n)))
    out = out.withColumns({"atr": full("tr", 14, F.avg), "avg20": full("volume", 20, F.avg), "low3": full("range_abs", 3, F.min), "low6": full("range_abs", 6, F.min), "idx": F.row_number().over(in_series())})
    out = out.withColumns({"nr4": plain(F.col("range_abs") < F.col("low3")), "nr7": plain(F.col("range_abs") < F.col("low6")), "atr14_pct": rounded(percent(F.col("atr"), pc), 6), "range_vs_atr": rounded(F.try_divide(F.col("range_abs"), F.col("atr")), 6), "vol_vs_avg20": rounded(F.try_divide(F.col("volume"), F.col("avg20")), 6)})
    upto = in_series().rowsBetween(Window.unboundedPreceding, 0)
    run = lambda cond: F.col("idx") - F.coalesce(F.max(F.when(~cond, F.col("idx"))).over(upto), F.lit(0))
    out = out.withColumns({"green_run": run(c > o), "red_run": run(c < o)})
    out = out.withColumns({"prev_green_streak": F.coalesce(_lag("green_run"), F.lit(0)), "prev_red_streak": F.coalesce(_lag("red_run"), F.lit(0))})
    out = out.withColumns({f"prev_{x}": F.when(use, _lag(x)) for x in ("inside_day", "nr7", "doji")})
    out = out.withColumns({f"next_{x}": F.lead(x).over(in_series()) for x in ("green", "ret_oc_pct", "range_pct", "range_vs_atr")})
    date = F.col("trade_date")
    out = out.withColumns({"session_id": F.concat_ws("|", "symbol", "session_key", date.cast("string")), "dow": F.date_format(date, "E"), "month": F.month(date), "year": F.year(date), "high_time_min": minutes_since(F.col("high_ts"), F.col("start_ts")), "low_time_min": minutes_since(F.col("low_ts"), F.col("start_ts")), "high_before_low": F.col("high_ts") < F.col("low_ts")})
    return out.drop("p_open", "p_high", "p_low", "p_close", "p_contract_last", "has_prev", "use_prev", "gap_raw", "tr", "atr", "avg20", "low3", "low6", "green_run", "red_run")


def touches(rows: DataFrame) -> DataFrame:
    """rows with what their first bars at the prior session's close, high and low say."""
    out = rows
    up = F.col("gap_dir") == "up"
    gapped, fill = F.col("gap_dir").isin("up", "down"), F.when(up, F.col("fill_up")).otherwise(F.col("fill_dn"))
    scanned = F.col("gap_dir").isNotNull()
    beyond = F.when(up, F.col("close") < F.col("prev_close")).otherwise(F.col("close") > F.col("prev_close"))
    since = lambda x: minutes_since(x, F.col("start_ts"))
    out = out.withColumns({"gap_filled": F.when(gapped, fill.isNotNull()), "gap_fill_min": F.when(gapped, since(fill)), "gap_reversed": F.when(gapped, fill.isNotNull() & beyond)})
    out = out.withColumns({"touched_prev_high": F.when(scanned, F.col("touch_h").isNotNull()), "touched_prev_low": F.when(scanned, F.col("touch_l").isNotNull()), "touch_prev_high_min": F.when(scanned, since(F.col("touch_h"))), "touch_prev_low_min": F.when(scanned, since(F.col("touch_l")))})
    return out.drop("fill_up", "fill_dn", "touch_h", "touch_l")


_ZONES, _SEEN = "array<struct<lo:double,hi:double,bull:boolean>>", "array<struct<fvg_above:boolean,fvg_below:boolean>>"


#: Sessions that the zones' fold takes at a time.
FOLDED = 128


def gap_zones(rows: DataFrame, cap: int = MAX_ZONES) -> DataFrame:
    """rows with fvg_above and fvg_below: whether an unfilled zone between sessions i-2 and i stands above or below the open.

    A zone lives until a later session's range pierces it; of more than cap, the oldest goes. The
    zones alive are folded over a series' sessions (a few thousand rows of one task), all of whose
    columns pass through, so that rows are derived once.
    """
    each = rows.groupBy("symbol", "session_key").agg(F.array_sort(F.collect_list(F.struct("trade_date", F.struct(*rows.columns).alias("r")))).alias("s"))
    opened = "named_struct('fvg_above', coalesce(exists(a.z, z -> not z.bull and z.lo > x.r.open), false), 'fvg_below', coalesce(exists(a.z, z -> z.bull and z.hi < x.r.open), false))"
    alive = "filter(a.z, z -> not if(z.bull, x.r.low <= z.lo, x.r.high >= z.hi))"
    born = f"if(x.r.low > a.h2, array(named_struct('lo', a.h2, 'hi', x.r.low, 'bull', true)), if(x.r.high < a.l2, array(named_struct('lo', x.r.high, 'hi', a.l2, 'bull', false)), cast(array() as {_ZONES})))"
    newest = f"transform(array(concat({alive}, {born})), c -> if(size(c) > {cap}, slice(c, size(c) - {cap - 1}, {cap}), c))[0]"
    none = "cast(null as double)"
    start = f"named_struct('z', cast(array() as {_ZONES}), 'seen', cast(array() as {_SEEN}), 'h2', {none}, 'l2', {none}, 'h1', {none}, 'l1', {none})"
    step = f"named_struct('z', {newest}, 'seen', concat(a.seen, array({opened})), 'h2', a.h1, 'l2', a.l1, 'h1', x.r.high, 'l1', x.r.low)"
    # What is seen grows by blocks: appending to all of it at each session would copy a series as often as it has sessions.
    blocks = f"transform(sequence(0, size(s) - 1, {FOLDED}), k -> slice(s, k + 1, {FOLDED}))"
    within = f"aggregate(b, named_struct('z', o.z, 'seen', cast(array() as {_SEEN}), 'h2', o.h2, 'l2', o.l2, 'h1', o.h1, 'l1', o.l1), (a, x) -> {step})"
    joined = f"transform(array({within}), i -> named_struct('z', i.z, 'seen', concat(o.seen, i.seen), 'h2', i.h2, 'l2', i.l2, 'h1', i.h1, 'l1', i.l1))[0]"
    fold = f"aggregate({blocks}, {start}, (o, b) -> {joined}, o -> o.seen)"
    return each.select(F.explode(F.arrays_zip("s", F.expr(fold).alias("seen"))).alias("e")).select("e.s.r.*", "e.seen.*")


def own_features(assigned: DataFrame, or_windows: tuple[int, ...] = OR_WINDOWS, ib: int = IB_WINDOW) -> DataFrame:
    """What a session's own bars and the prior levels say; the rows that series_features() needs, and that a live store keeps."""
    return opening_ranges(session_stats(assigned, or_windows), or_windows, ib)


def own_of_parts(parts: DataFrame, or_windows: tuple[int, ...] = OR_WINDOWS, ib: int = IB_WINDOW) -> DataFrame:
    """own_features() from whole sessions' parts, of whole series."""
    return opening_ranges(stats_of_parts(parts, or_windows), or_windows, ib)


def series_features(own: DataFrame, bar_ms: int) -> DataFrame:
    """All features, from own_features() of whole series."""
    return gap_zones(touches(cross_session(own, bar_ms)))


def features(assigned: DataFrame, bar_ms: int, or_windows: tuple[int, ...] = OR_WINDOWS, ib: int = IB_WINDOW) -> DataFrame:
    """All features of every session that has bars."""
    return series_features(own_features(assigned, or_windows, ib), bar_ms)


def developing_series(own: DataFrame, parts: DataFrame, bar_ms: int, or_windows: tuple[int, ...] = OR_WINDOWS, ib: int = IB_WINDOW) -> DataFrame:
    """All features of the series of parts (partials of the sessions that go on), up to these; live marks their rows.

    own: own_features() of the sessions before; no earlier bar is read. Live sessions replace
    rows of their key that own may have.
    """
    keys = parts.select("symbol", "session_key", F.col("trade_date").alias("today"))
    before = own.join(keys, ["symbol", "session_key"]).filter("trade_date < today").drop("today")
    now = partials.sessions(parts)
    known = ["symbol", "session_key", "trade_date", "close", "high", "low", "contract_first", "contract_last"]
    both = before.select(*known).unionByName(now.select(*known))
    levels = both.select(*KEYS, *(c.alias(name) for name, c in prior_levels(both).items())).join(parts.select(*KEYS), KEYS, "left_semi")
    mine = opening_ranges(partials.stats(now.join(levels, KEYS, "left"), or_windows).drop("lag_close", "lag_high", "lag_low"), or_windows, ib)
    rows = before.withColumn("live", F.lit(False)).unionByName(mine.withColumn("live", F.lit(True)))
    return series_features(rows, bar_ms)


def developing_features(own: DataFrame, live: DataFrame, bar_ms: int, or_windows: tuple[int, ...] = OR_WINDOWS, ib: int = IB_WINDOW) -> DataFrame:
    """Features of the sessions that live (assigned bars so far) has, as of its last bars."""
    return developing_series(own, partials.partials(live, or_windows), bar_ms, or_windows, ib).filter("live").drop("live")
