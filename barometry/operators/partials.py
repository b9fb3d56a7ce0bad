"""A session's bars as an aggregate that merges: parts of any split of the bars give the same session.

Besides counts, sums, the first and the last, a part keeps stairs: the bars at which the high
rose above all highs before it (the low fell below all lows), as (ts, v). They tell the first
bar at any level, known later or not: the prior session's close, high and low, or what turns
out to be the opening range. An opening range's breaks need the stairs of the bars behind it.
Stairs are a few dozen bars long, and no longer than the session.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE_MS

KEYS = ["symbol", "session_key", "trade_date"]
FRAME = [*KEYS, "start_ts", "end_ts", "is_half_day"]
OR_WINDOWS = (5, 10, 15, 30, 60)
_STEPS = "array<struct<ts:bigint,v:double>>"


def stairs(windows: tuple[int, ...]) -> list[tuple[str, int, bool]]:
    """Name, first minute and direction of the stairs that a part keeps."""
    return [(f"{name}{w or ''}", w, up) for w in (0, *windows) for name, up in (("highs", True), ("lows", False))]


def schema(windows: tuple[int, ...] = OR_WINDOWS) -> str:
    """A part's columns but FRAME."""
    ends = [f"{x} struct<ts:bigint,v:{kind}>" for x, kind in (("first", "double"), ("last", "double"), ("contract_first", "string"), ("contract_last", "string"))]
    return ", ".join(["bar_count int", "volume double", *ends, *(f"bars{w} int" for w in windows), *(f"{name} {_STEPS}" for name, _, _ in stairs(windows))])


def partials(assigned: DataFrame, windows: tuple[int, ...] = OR_WINDOWS, within: tuple[str, ...] = ()) -> DataFrame:
    """One part per session (and per within, columns by which the bars are stored together, such as the day), from one shuffle of the bars, or none if they lie so."""
    own = Window.partitionBy(*KEYS, *within).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    since = lambda w: F.col("ts") >= F.col("start_ts") + w * MINUTE_MS
    steps: dict[str, Column] = {}
    for name, w, up in stairs(windows):
        v = F.when(since(w), F.col("high" if up else "low")) if w else F.col("high" if up else "low")
        before = (F.max if up else F.min)(v).over(own)
        steps[name] = F.when(v.isNotNull() & (before.isNull() | (v > before if up else v < before)), v)
    made = assigned.withColumns(steps)
    at = lambda x: F.struct("ts", F.col(x).alias("v"))
    contract = F.when(F.col("contract").isNotNull(), at("contract"))
    sums = [F.count("*").cast("int").alias("bar_count"), F.sum("volume").alias("volume"), F.min(at("open")).alias("first"), F.max(at("close")).alias("last"), F.min(contract).alias("contract_first"), F.max(contract).alias("contract_last")]
    sums += [F.count(F.when(~since(w), 1)).cast("int").alias(f"bars{w}") for w in windows]
    sums += [F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), at(name)))).alias(name) for name in steps]
    return made.groupBy(*FRAME, *within).agg(*sums).drop(*within)


def merged(parts: DataFrame, windows: tuple[int, ...] = OR_WINDOWS) -> DataFrame:
    """Parts of the same sessions as one part each, in whatever order they come."""

    def joined(name: str, up: bool) -> Column:
        higher = f"s.v {'>' if up else '<'} get(steps, size(steps) - 1).v"
        return F.expr(f"aggregate(array_sort(flatten(collect_list({name}))), cast(array() as {_STEPS}), (steps, s) -> if(size(steps) = 0 or {higher}, concat(steps, array(s)), steps))").alias(name)

    sums = [F.sum(x).cast("int").alias(x) for x in ("bar_count", *(f"bars{w}" for w in windows))]
    ends = [f(x).alias(x) for f, x in ((F.min, "first"), (F.max, "last"), (F.min, "contract_first"), (F.max, "contract_last"))]
    return parts.groupBy(*FRAME).agg(*sums, F.sum("volume").alias("volume"), *ends, *(joined(name, up) for name, _, up in stairs(windows)))


def extreme(name: str, up: bool, until: str | None = None) -> Column:
    """The highest (lowest) step of stairs, of those before a time if one is given."""
    steps = f"filter({name}, s -> s.ts < {until})" if until else name
    return F.expr(f"{'array_max' if up else 'array_min'}(transform({steps}, s -> s.v))")


def reached(name: str, level: str, how: str) -> Column:
    """When stairs first stand so to a level; null if never, or without a level."""
    return F.expr(f"get(filter({name}, s -> s.v {how} {level}), 0).ts")


def sessions(parts: DataFrame) -> DataFrame:
    """Parts with the session's own open, high, low, close, first and last bar and contracts."""
    own = {"high": extreme("highs", True), "low": extreme("lows", False), "open": F.col("first.v"), "close": F.col("last.v"), "first_ts": F.col("first.ts"), "last_ts": F.col("last.ts"), "contract_first": F.col("contract_first.v"), "contract_last": F.col("contract_last.v")}
    return parts.withColumns(own).drop("first", "last")


def stats(rows: DataFrame, windows: tuple[int, ...] = OR_WINDOWS) -> DataFrame:
    """sessions() that know the prior levels (lag_close, lag_high, lag_low; null: none), with the times of all first touches and each opening range's levels, breaks and extremes."""
    out = rows.withColumns({"high_ts": reached("highs", "high", ">="), "low_ts": reached("lows", "low", "<="), "fill_up": reached("lows", "lag_close", "<="), "fill_dn": reached("highs", "lag_close", ">="), "touch_h": reached("highs", "lag_high", ">="), "touch_l": reached("lows", "lag_low", "<=")})
    for w in windows:
        end = f"start_ts + {w * MINUTE_MS}"
        out = out.withColumns({f"h{w}": extreme("highs", True, end), f"l{w}": extreme("lows", False, end), f"ph{w}": extreme(f"highs{w}", True), f"pl{w}": extreme(f"lows{w}", False)})
        out = out.withColumns({f"up{w}": reached(f"highs{w}", f"h{w}", ">"), f"dn{w}": reached(f"lows{w}", f"l{w}", "<")})
    return out.drop(*(name for name, _, _ in stairs(windows)))
