"""Registered queries over the given tables, each with the SQL that says the same.

Bars in sessions and features are derived once in a session for a state of the events table and
read by all queries (``sources.store``); queries that are about deriving them don't.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import epoch_ms, rounded
from .operators import calendars, derive, ingest, lookups, partials, trades
from .plans import catalog, envelope, oracle, tallies
from .plans.catalog import Preset
from .plans.oracle import Ask
from .sources import bridge, readers, sinks
from .sources.store import kept, once, shared_folder
from .streaming import live, monitor
from .streaming.live import Watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SMALL = {"warn": 5, "refuse": 2}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def dates(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))


def definitions(spark: SparkSession, key: str) -> DataFrame:
    return spark.createDataFrame([(key, *oracle.SESSIONS[key])], calendars.DEFS)


def windows(spark: SparkSession, bars: DataFrame, defs: DataFrame, half_days: bool = False, every: bool = False) -> DataFrame:
    holidays = None if every else dates(spark, [(d,) for d in oracle.HOLIDAYS], "date string")
    early = dates(spark, list(oracle.HALF_DAYS), "date string, close_min int") if half_days else None
    return calendars.session_windows(calendars.spans(bars), defs, holidays, early)


def key_windows(spark: SparkSession, bars: DataFrame, key: str, half_days: bool = False) -> DataFrame:
    return windows(spark, bars, definitions(spark, key), half_days, oracle.SESSIONS[key][-1])


def assigned(spark: SparkSession, d: str, key: str = "utc") -> DataFrame:
    bars = bridge.bars(spark, d)
    return calendars.assign(bars, key_windows(spark, bars, key))


def stored_bars(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "bars", [f"{d}/events.parquet"], lambda: bridge.bars(spark, d))


def stored_assigned(spark: SparkSession, d: str, key: str = "utc") -> DataFrame:
    def build() -> DataFrame:
        bars = stored_bars(spark, d)
        return calendars.assign(bars, key_windows(spark, bars, key))

    return once(spark, f"assigned-{key}", [f"{d}/events.parquet"], build)


def features(spark: SparkSession, d: str, key: str = "utc") -> DataFrame:
    return once(spark, f"features-{key}", [f"{d}/events.parquet"], lambda: derive.features(stored_assigned(spark, d, key), oracle.BAR_MS))


def event_rows(spark: SparkSession) -> DataFrame:
    return dates(spark, [(x, name) for name, days in oracle.EVENTS for x in days], "date string, event string")


def with_events(spark: SparkSession, d: str, key: str = "utc") -> DataFrame:
    return envelope.with_events(features(spark, d, key), event_rows(spark), [name for name, _ in oracle.EVENTS])


def hits(spark: SparkSession, d: str, presets: Sequence[Preset], **span) -> DataFrame:
    return envelope.matched(with_events(spark, d), presets, **span)


def pick(columns: str, key: str = "utc") -> tuple:
    """A query that shows some feature columns of every session."""
    names = [*derive.KEYS, *columns.split()]
    return lambda s, d: features(s, d, key).select(*names), f"with {oracle.features(key)} select {', '.join(names)} from feat"


def ask(presets: Sequence[Preset], asked: Sequence[Ask], **span: str) -> tuple:
    """A query that counts presets, and the SQL of the same questions."""
    since, until = span.get("since"), span.get("until")
    limits = " and ".join(["true", *([f"trade_date >= date '{since}'"] if since else []), *([f"trade_date <= date '{until}'"] if until else [])])
    return lambda s, d: envelope.counted(hits(s, d, presets, **span), envelope.KEYS, **SMALL), oracle.hits(asked, span=limits) + oracle.counted("qid, symbol, session_key", **SMALL)


def named(asked: Ask, name: str, **changes: str) -> Ask:
    return asked._replace(name=name, **changes)


GREEN_SQL, FILL_SQL = oracle.OUTCOMES["close_green"], oracle.OUTCOMES["gap_fill"]
GAP = [Preset("q", catalog.gap_fill())]
GREEN = [Preset("q", catalog.close_green())]
ASK_GAP, ASK_GREEN = [named(FILL_SQL, "q")], [named(GREEN_SQL, "q")]

# Ingest.
register("resample_bars", lambda s, d: ingest.with_year(bridge.bars(s, d)), f"with {oracle.BARS} select *, cast(year(make_timestamp(ts * 1000)) as integer) as year from bars")
register(
    "epoch_normalise",
    lambda s, d: bridge.ticks(s, d).select("symbol", "ts", *(epoch_ms((F.col("ts") * m if m > 0 else F.call_function("div", "ts", F.lit(-m).cast("long"))).cast("string")).alias(name) for name, m in (("from_s", -1000), ("from_ms", 1), ("from_us", 1000), ("from_ns", 1000000)))),
    f"with {oracle.TICKS} select symbol, ts, ts // 1000 * 1000 as from_s, ts as from_ms, ts as from_us, ts as from_ns from ticks",
)


def dedupe_clamp(s: SparkSession, d: str) -> DataFrame:
    bars = bridge.bars(s, d).withColumn("tf", F.lit("15m")).withColumn("source", F.lit(1))
    again = bars.withColumn("close", F.col("close") + 1).withColumn("source", F.lit(2))
    return ingest.clamp(ingest.dedupe(again.union(bars), first="source"), 1704585600000, 1705881600000).select("symbol", "ts", "close", "source")


register("dedupe_clamp", dedupe_clamp, f"with {oracle.BARS} select symbol, ts, close, 1 as source from bars where ts > 1704585600000 and ts <= 1705881600000")


def incremental_append(s: SparkSession, d: str) -> DataFrame:
    bars = bridge.bars(s, d).withColumn("tf", F.lit("15m"))
    marks = ingest.watermarks(bars.filter(F.when(F.col("symbol") == "click", F.lit(1705881600000)).otherwise(F.lit(1704585600000)) >= F.col("ts")))
    return ingest.unseen(bars, marks).select("symbol", "ts", "close")


register("incremental_append", incremental_append, f"with {oracle.BARS}, marks as (select symbol, max(ts) as last_ts from bars where ts <= case when symbol = 'click' then 1705881600000 else 1704585600000 end group by symbol) select b.symbol, b.ts, b.close from bars b left join marks m using (symbol) where last_ts is null or ts > last_ts")

# Sessions.
for _key in oracle.SESSIONS:
    register(f"session_windows_{_key}", lambda s, d, k=_key: key_windows(s, bridge.bars(s, d), k), f"with {oracle.BARS}, {oracle.windows(_key)} select * from wins")
    register(f"assign_bars_{_key}", lambda s, d, k=_key: assigned(s, d, k).select("symbol", "session_key", "trade_date", "ts", "open", "close"), f"with {oracle.assigned(_key)} select symbol, session_key, trade_date, ts, open, close from inside")


def together(s: SparkSession, d: str) -> DataFrame:
    """Features of overnight sessions from bars that are stored by symbol and day: no bar is shuffled."""
    bars = stored_bars(s, d)
    name = "b" + shared_folder(s, "together").rsplit("-", 1)[1]
    calendars.keep_together(bars, key_windows(s, bars, "overnight"), name, shared_folder(s, name), buckets=16)
    parts = partials.merged(partials.partials(calendars.assign_together(s, name), within=("day",)))
    return derive.series_features(derive.own_of_parts(parts), oracle.BAR_MS).select(*_WIDE_OR)


_WIDE_OR = [*derive.KEYS, "bar_count", "open", "high", "low", "close", "volume", "high_time_min", "gap_pct", "gap_fill_min", "touch_prev_low_min", "or15_first_break", "or60_ext_up_r", "ib_break", "range_vs_atr", "fvg_above"]
register("features_together", together, f"with {oracle.features('overnight')} select {', '.join(_WIDE_OR)} from feat")
register("half_day_windows", lambda s, d: key_windows(s, bridge.bars(s, d), "ny", True), f"with {oracle.BARS}, {oracle.windows('ny', True)} select * from wins")
for _exchange, _defs in oracle.EXCHANGES.items():
    register(
        f"exchange_windows_{_exchange.lower()}",
        lambda s, d, x=_exchange: windows(s, stored_bars(s, d), calendars.definitions(s, x), every=x == "CRYPTO"),
        f"with {oracle.BARS}, {oracle.DAYS} " + " union all ".join(map(oracle.window_rows, _defs)),
    )
# Symbols of each class by the length of their names, one with sessions of its own.
_CLASSES = ("equity", "future", "crypto", "forex")
_OVER = [("click", "rth", 510, 900, "America/New_York", False, False), ("click", "lunch", 720, 780, "Europe/London", False, False)]


def classed(s: SparkSession, d: str) -> DataFrame:
    return stored_bars(s, d).select("symbol").distinct().withColumn("asset_class", F.element_at(F.array(*map(F.lit, _CLASSES)), F.length("symbol") % 4 + 1))


def symbol_windows(s: SparkSession, d: str) -> DataFrame:
    defs = calendars.symbol_definitions(classed(s, d), s.createDataFrame(_OVER, f"symbol string, {calendars.DEFS}"))
    return windows(s, stored_bars(s, d), defs, every=True)


_OF_CLASS = [(f"length(symbol) % 4 = {i}", x) for i, x in enumerate(oracle.EXCHANGES)]
_SYMBOL_WINDOWS = [oracle.window_rows((*x[:5], True), which=f"{of} and isodow(d) <= {7 if x[5] else 5} and not (symbol = 'click' and '{x[0]}' = 'rth')") for of, exchange in _OF_CLASS for x in oracle.EXCHANGES[exchange]]
_SYMBOL_WINDOWS += [oracle.window_rows((*x[1:6], True), which="symbol = 'click' and isodow(d) <= 5") for x in _OVER]
register("symbol_windows", symbol_windows, f"with {oracle.BARS}, {oracle.DAYS} " + " union all ".join(_SYMBOL_WINDOWS))
register(
    "symbol_defaults",
    lambda s, d: calendars.with_defaults(classed(s, d)),
    "select distinct event_type as symbol, case length(event_type) % 4 when 0 then 'equity' when 1 then 'future' when 2 then 'crypto' else 'forex' end as asset_class, case length(event_type) % 4 when 0 then 'NYSE' when 1 then 'CME' when 2 then 'CRYPTO' else 'FX' end as exchange, case length(event_type) % 4 when 2 then 'utc' when 3 then 'london' else 'rth' end as default_session from events",
)
register(
    "calendar_of_symbol",
    lambda s, d: calendars.calendar(windows(s, stored_bars(s, d), calendars.definitions(s, "CME")), "click", "2024-01-10", "2024-01-19"),
    f"with {oracle.BARS}, {oracle.DAYS} select * from (" + " union all ".join(map(oracle.window_rows, oracle.EXCHANGES["CME"])) + ") where symbol = 'click' and trade_date between date '2024-01-10' and date '2024-01-19'",
)

# Features.
_OR = [f"or{w}_{x}" for w in derive.OR_WINDOWS for x in ("high", "low", "range")]
_BREAK = [f"or{w}_{x}" for w in derive.OR_WINDOWS for x in ("first_break", "break_min", "false_break", "broke_both", "ext_up_r", "ext_dn_r")]
FAMILIES = {
    "feat_session_agg": "start_ts end_ts is_half_day bar_count first_ts last_ts open high low close volume complete session_id dow month year range_abs range_pct ret_oc_pct green",
    "feat_contract_roll": "contract_first contract_last is_roll_day",
    "feat_opening_range": " ".join(_OR),
    "feat_or_break": " ".join(_BREAK),
    "feat_initial_balance": "ib_break",
    "feat_extremes": "high_time_min low_time_min high_before_low",
    "feat_prev_levels": "prev_close prev_high prev_low prev_mid prev_range open_pos_prev_range open_above_prev_high open_below_prev_low closed_above_prev_high closed_below_prev_low",
    "feat_gap": "gap_abs gap_pct abs_gap_pct gap_dir gap_bucket",
    "feat_gap_fill": "gap_filled gap_fill_min gap_reversed",
    "feat_touch": "touched_prev_high touched_prev_low touch_prev_high_min touch_prev_low_min",
    "feat_shape": "inside_day outside_day bull_engulf bear_engulf doji prev_day_green",
    "feat_atr": "atr14_pct range_vs_atr",
    "feat_volume_ratio": "vol_vs_avg20",
    "feat_nr": "nr4 nr7",
    "feat_streak": "prev_green_streak prev_red_streak",
    "feat_fvg": "fvg_above fvg_below",
    "feat_next": "next_green next_ret_oc_pct next_range_pct next_range_vs_atr",
    "feat_prev_shape": "prev_inside_day prev_nr7 prev_doji",
}
for _name, _columns in FAMILIES.items():
    register(_name, *pick(_columns))
for _key in ("utc", "ny", "overnight"):
    register("features_wide" if _key == "utc" else f"features_wide_{_key}", *pick(" ".join(FAMILIES.values()), _key))

# Outcomes, conditions, events.
for _name, _outcome in catalog.OUTCOMES.items():
    register(f"outcome_{_name}", *ask([Preset(_name, _outcome)], [oracle.OUTCOMES[_name]]))
_FIRST = {"up": "or{w}_first_break = 'up'", "down": "or{w}_first_break = 'down'", "any": "or{w}_first_break <> 'none'"}
_WHICH = [(w, side) for w in derive.OR_WINDOWS for side in ("up", "down", "any")]
register("outcome_orb_any_ladder_sides", *ask([Preset(f"{side}{w}", catalog.orb_break(w, side)) for w, side in _WHICH], [Ask(f"{side}{w}", f"or{w}_high is not null", _FIRST[side].format(w=w), f"or{w}_break_min") for w, side in _WHICH]))
_CONDITIONS = {
    "q": (f"({catalog.gap_side('up')} or {catalog.streak('red', 1)}) and {catalog.negated('inside_day')}", "(gap_dir = 'up' or prev_red_streak >= 1) and not coalesce(inside_day, false)"),
    "not": (catalog.negated(catalog.gap_side("down")), "gap_dir is null or gap_dir <> 'down'"),
    "predicates": (" or ".join([catalog.no_gap(), catalog.orb_false_broke(15), catalog.orb_broke_both(30), catalog.ib_single_break(), catalog.fvg_present("below")]), "gap_dir is null or gap_dir = 'none' or (or15_first_break <> 'none' and or15_false_break) or or30_broke_both or ib_break = 'single_up' or ib_break = 'single_down' or fvg_below"),
    "more": (f"{catalog.orb_broke(15, 'up')} and ({catalog.ib_double_break()} or {catalog.ib_no_break()})", "or15_first_break = 'up' and (ib_break = 'double' or ib_break = 'none')"),
}
register("cond_and_or_not", *ask([Preset(k, catalog.close_green(), spark) for k, (spark, _) in _CONDITIONS.items()], [named(GREEN_SQL, k, where=sql) for k, (_, sql) in _CONDITIONS.items()]))
register(
    "cond_between_in",
    *ask(
        [Preset("q", catalog.gap_fill(), "gap_pct between -0.5 and 0.8 and dow in ('Tue', 'Wed', 'Fri')"), Preset("bool", catalog.close_green(), "high_before_low")],
        [named(FILL_SQL, "q", where="gap_pct >= -0.5 and gap_pct <= 0.8 and isodow(trade_date) in (2, 3, 5)"), named(GREEN_SQL, "bool", where="high_ts < low_ts")],
    ),
)
register("cond_since_until", *ask(GREEN, ASK_GREEN, since="2024-01-08", until="2024-01-20"))
for _when, _condition, _column in (("day", catalog.event_day, "ev_{}"), ("before", catalog.day_before_event, "next_ev_{}"), ("after", catalog.day_after_event, "prev_ev_{}")):
    register(f"event_{_when}", *ask([Preset(n, catalog.close_green(), _condition(n)) for n, _ in oracle.EVENTS], [named(GREEN_SQL, n, where=_column.format(n.lower())) for n, _ in oracle.EVENTS]))
register("event_occurs", *ask([Preset(n, catalog.event_occurs(n)) for n, _ in oracle.EVENTS], [Ask(n, "true", f"ev_{n.lower()}") for n, _ in oracle.EVENTS]))
_FIELDS = [*catalog.GROUPABLE]
register("fields_groupable", lambda s, d: features(s, d).select(*derive.KEYS, *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in _FIELDS)), f"with {oracle.features()} select symbol, session_key, trade_date, " + ", ".join(f"coalesce(cast({c} as varchar), 'NULL') as {c}" for c in _FIELDS) + " from feat")

# Envelopes.
_P, _LOW, _HIGH = oracle.wilson("n", "k")
_Q = "qid, symbol, session_key"
_SUM = "cast(sum(case when {} and success then 1 else 0 end) as bigint)"


def _bounds(n: str, k: str) -> tuple[str, str]:
    return oracle.wilson(n, k)[1:]


(_A, _B), (_C, _D) = _bounds("n1", "k1"), _bounds("n2", "k2")
register("env_stability", lambda s, d: envelope.stability(hits(s, d, GREEN)), oracle.hits(ASK_GREEN) + f"select *, case when n1 > 0 and n2 > 0 then {_A} <= {_D} and {_C} <= {_B} end as agree from (select {_Q}, count(*) filter (rn * 2 <= total) as n1, {_SUM.format('rn * 2 <= total')} as k1, count(*) filter (rn * 2 > total) as n2, {_SUM.format('rn * 2 > total')} as k2 from hits group by {_Q})")
(_A, _B), (_C, _D) = _bounds("n", "k"), _bounds("n_recent", "k_recent")
register("env_recency", lambda s, d: envelope.recency(hits(s, d, GREEN), 8), oracle.hits(ASK_GREEN) + f"select *, {_A} > {_D} or {_C} > {_B} as diverges from (select {_Q}, count(*) as n, {_SUM.format('true')} as k, count(*) filter (rn > total - 8) as n_recent, {_SUM.format('rn > total - 8')} as k_recent from hits group by {_Q}) where n > 8")
register("env_per_year", lambda s, d: envelope.per_year(hits(s, d, GREEN)), oracle.hits(ASK_GREEN) + f"select * exclude (low_sample, refused) from ({oracle.counted(_Q + ', year', source='(select *, cast(year(trade_date) as integer) as year from hits)', force=True)})")
_ASK_VALUES = [named(FILL_SQL, "gap"), named(GREEN_SQL, "ret"), Ask("ext", "or30_first_break <> 'none'", "case when or30_first_break = 'up' then or30_ext_up_r else or30_ext_dn_r end >= 1", "case when or30_first_break = 'up' then or30_ext_up_r when or30_first_break = 'down' then or30_ext_dn_r end")]
_VALUES = [Preset("gap", catalog.gap_fill()), Preset("ret", catalog.close_green()), Preset("ext", catalog.orb_target_hit(30, 1))]
register("env_distribution", lambda s, d: envelope.distribution(hits(s, d, _VALUES)).withColumn("mean", rounded(F.col("mean"), 6)).select(*envelope.KEYS, "count", "mean", *(rounded(F.col(c), 6).alias(c) for c in ("min", "p25", "median", "p75", "p90", "max"))), oracle.hits(_ASK_VALUES) + f"select {_Q}, count(value) as count, {oracle.r6('avg(value)')} as mean, " + ", ".join(f"{oracle.r6(f'quantile_cont(value, {q})')} as {name}" for q, name in ((0.0, "min"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"), (1.0, "max"))) + f" from hits group by {_Q}")
_GROUPED = [Preset("bucket", catalog.gap_fill(), by="gap_bucket"), Preset("dow", catalog.close_green(), by="dow"), Preset("roll", catalog.close_green(), by="gap_dir")]
register("env_groups", lambda s, d: envelope.groups(hits(s, d, _GROUPED)), oracle.hits([named(FILL_SQL, "bucket", by="gap_bucket"), named(GREEN_SQL, "dow", by="dow"), named(GREEN_SQL, "roll", by="gap_dir")]) + oracle.counted(_Q + ", grp", source="(select * replace (coalesce(grp, 'NULL') as grp) from hits)", force=True))
_RARE = [Preset("inside", catalog.close_green(), "inside_day"), Preset("all", catalog.close_green())]
register("env_guards", lambda s, d: envelope.counted(hits(s, d, _RARE), envelope.KEYS), oracle.hits([named(GREEN_SQL, "inside", where="inside_day"), named(GREEN_SQL, "all")]) + oracle.counted(_Q))
register("env_forced", lambda s, d: envelope.counted(hits(s, d, _RARE), envelope.KEYS, force=True), oracle.hits([named(GREEN_SQL, "inside", where="inside_day"), named(GREEN_SQL, "all")]) + oracle.counted(_Q, force=True))


def env_full(s: SparkSession, d: str) -> DataFrame:
    rows = envelope.envelope(with_events(s, d), catalog.gap_fill(), by="gap_bucket", **SMALL)
    return rows.select("symbol", "session_key", "n", "k", "estimate", "ci_low", "ci_high", F.col("stability.agree").alias("agree"), F.col("distribution.median").alias("median"), F.size("years").cast("long").alias("n_years"), F.size("groups").cast("long").alias("n_groups"))


(_A, _B), (_C, _D) = _bounds("n1", "k1"), _bounds("n2", "k2")
register("env_full", env_full, oracle.hits([named(FILL_SQL, "q", by="gap_bucket")]) + f", halves as (select symbol, session_key, count(*) filter (rn * 2 <= total) as n1, {_SUM.format('rn * 2 <= total')} as k1, count(*) filter (rn * 2 > total) as n2, {_SUM.format('rn * 2 > total')} as k2, quantile_cont(value, 0.5) as median, count(distinct year(trade_date)) as n_years, count(distinct coalesce(grp, 'NULL')) as n_groups from hits group by all) select c.symbol, c.session_key, n, k, estimate, ci_low, ci_high, case when n1 > 0 and n2 > 0 then {_A} <= {_D} and {_C} <= {_B} end as agree, median, n_years, n_groups from ({oracle.counted('symbol, session_key', **SMALL)}) c join halves using (symbol, session_key)")

# Sessions one by one.
register("matched_sessions", lambda s, d: envelope.latest(hits(s, d, GAP), 5), oracle.hits(ASK_GAP) + f"select {_Q}, session_id, trade_date, success, value from hits where rn > total - 5")
register("drilldown", lambda s, d: lookups.drilldown(features(s, d), envelope.latest(hits(s, d, GAP), 2).select("session_id")).select("session_id", "open", "close", "gap_pct"), oracle.hits(ASK_GAP) + "select session_id, open, close, gap_pct from feat where session_id in (select session_id from hits where rn > total - 2)")
register("session_bars", lambda s, d: lookups.session_bars(stored_assigned(s, d, "ny"), F.col("trade_date") == F.to_date(F.lit("2024-01-17"))).select("symbol", "ts", "open", "high", "low", "close"), f"with {oracle.assigned('ny')} select symbol, ts, open, high, low, close from inside where trade_date = date '2024-01-17'")


def context_bars(s: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(s, d)
    return lookups.context_bars(bars, key_windows(s, bars, "ny"), oracle.BAR_MS, 10)


_NEAR = "near as (select w.symbol, w.session_key, w.trade_date, b.ts, b.close, w.start_ts, row_number() over (partition by w.symbol, w.session_key, w.trade_date order by b.ts desc) as back from wins w join bars b on b.symbol = w.symbol and b.ts < w.start_ts and b.ts >= w.start_ts - 7 * 86400000)"
_LABEL = f"case when start_ts - max(ts) over (partition by symbol, session_key, trade_date) <= 2 * {oracle.BAR_MS} then 'pre-session' else 'prior-session' end as label"
register("context_bars", context_bars, f"with {oracle.BARS}, {oracle.windows('ny')}, {_NEAR} select symbol, session_key, trade_date, ts, close, {_LABEL} from near where back <= 10")
register(
    "context_labels",
    lambda s, d: lookups.context_labels(key_windows(s, stored_bars(s, d), "ny"), context_bars(s, d)),
    f"with {oracle.BARS}, {oracle.windows('ny')}, {_NEAR}, told as (select symbol, session_key, trade_date, case when max(start_ts) - max(ts) <= 2 * {oracle.BAR_MS} then 'pre-session' else 'prior-session' end as label from near group by symbol, session_key, trade_date) select symbol, session_key, trade_date, coalesce(label, 'none') as label from wins left join told using (symbol, session_key, trade_date)",
)
_LEVELS = [("open", "open", "0"), ("high", "high", "high_time_min"), ("low", "low", "low_time_min"), ("close", "close", "null"), ("prev_mid", "prev_mid", "null"), ("prev_close", "prev_close", "gap_fill_min"), ("prev_high", "prev_high", "touch_prev_high_min"), ("prev_low", "prev_low", "touch_prev_low_min")]
_LEVELS += [(f"or{w}_{side}", f"or{w}_{side}", f"or{w}_break_min") for w in (5, 10, 15, 30, 60) for side in ("high", "low")]
register("session_levels", lambda s, d: lookups.levels(features(s, d)), f"with {oracle.features()} " + " union all ".join(f"select session_id, '{name}' as name, cast({value} as double) as level, cast({minute} as integer) as minute from feat where {value} is not null" for name, value, minute in _LEVELS))
_FACTS = "session_id, gap_abs, gap_pct, gap_dir, gap_filled, touched_prev_high, touched_prev_low, ib_break"
register(
    "session_level_facts",
    lambda s, d: lookups.level_facts(features(s, d)).select(*_FACTS.split(", "), "ib_window", F.explode("opening_ranges").alias("r")).select(*_FACTS.split(", "), "ib_window", "r.*"),
    f"with {oracle.features()} " + " union all ".join(f"select {_FACTS}, 60 as ib_window, {w} as \"window\", or{w}_high as high, or{w}_low as low, or{w}_first_break as first_break, or{w}_break_min as break_min from feat" for w in oracle.OR_WINDOWS),
)
_MARKED = ("gap_fill", "gap_hold", "orb_break", "ib_extension", "touch_prev_high", "break_hold_prev_low", "time_of_high_before", "time_of_low_before", "close_green")


def outcome_marker(s: SparkSession, d: str) -> DataFrame:
    rows = features(s, d)
    return reduce(DataFrame.unionByName, (envelope.marker(rows, catalog.OUTCOMES[name]).withColumn("outcome", F.lit(name)) for name in _MARKED))


def _marks(name: str, level: str, minute: str, verb: str, side: str) -> str:
    return f"select session_id, {level} as level, {minute} as minute, {verb} as verb, {side} as side, '{name}' as outcome from feat where {level} is not null"


def _range_mark(name: str, w: int) -> str:
    return _marks(name, f"case or{w}_first_break when 'down' then or{w}_low else or{w}_high end", f"case when or{w}_first_break <> 'none' then or{w}_break_min end", f"case or{w}_first_break when 'up' then 'broke up' when 'down' then 'broke down' else 'range held' end", f"case or{w}_first_break when 'down' then 'below' else 'above' end")


_GAP_MARK = ("case when gap_dir in ('up', 'down') then prev_close end", "gap_fill_min", "case when gap_fill_min is null then 'not filled' else 'filled' end", "case when gap_dir = 'down' then 'above' else 'below' end")
_MARK_SQL = [_marks("gap_fill", *_GAP_MARK), _marks("gap_hold", *_GAP_MARK), _range_mark("orb_break", 15), _range_mark("ib_extension", 60)]
_MARK_SQL += [_marks(name, f"prev_{x}", f"touch_prev_{x}_min", f"case when touch_prev_{x}_min is null then 'not touched' else 'touched' end", f"'{side}'") for name, x, side in (("touch_prev_high", "high", "above"), ("break_hold_prev_low", "low", "below"))]
_MARK_SQL += [_marks(f"time_of_{x}_before", x, f"{x}_time_min", f"'{x}'", f"'{side}'") for x, side in (("high", "above"), ("low", "below"))]
register("outcome_marker", outcome_marker, f"with {oracle.features()} " + " union all ".join(_MARK_SQL))

# Sweeps.
register("preset_sweep", lambda s, d: envelope.sweep(with_events(s, d), catalog.PRESETS, **SMALL), oracle.hits(oracle.PRESETS) + oracle.counted(_Q, **SMALL))
_BY = [p for p in catalog.PRESETS if "null" not in p.by]
_GROUP_SQL = _Q + ", grp"
register("preset_sweep_groups", lambda s, d: envelope.groups(hits(s, d, _BY)), oracle.hits([q for q in oracle.PRESETS if q.by != "null"]) + oracle.counted(_GROUP_SQL, source="(select * replace (coalesce(grp, 'NULL') as grp) from hits)", force=True))
for _preset, _asked in zip(catalog.PRESETS, oracle.PRESETS, strict=True):
    register(f"preset_{_preset.name.replace('-', '_')}", lambda s, d, p=_preset: envelope.groups(hits(s, d, [p])), oracle.hits([_asked]) + oracle.counted(_GROUP_SQL, source="(select * replace (coalesce(grp, 'NULL') as grp) from hits)", force=True))
_VARIED = [catalog.preset(**given)._replace(name=str(i)) for i, (given, _) in enumerate(oracle.VARIED)]
register("preset_parameters", *ask(_VARIED, [named(q, str(i)) for i, (_, q) in enumerate(oracle.VARIED)]))
_TARGETS = (0.25, 0.5, 1, 1.5, 2, 3)


def stored_sweep(s: SparkSession, d: str) -> DataFrame:
    """The battery up to a date from stored tallies, after one symbol's rows have come late: only its series is asked again."""
    place, rows = shared_folder(s, "tallies"), with_events(s, d)
    late = (F.col("symbol") == "click") & (F.col("trade_date") > F.to_date(F.lit("2024-01-10")))
    tallies.refresh(rows.filter(~late), catalog.BATTERY, place)
    tallies.refresh(rows, catalog.BATTERY, place)
    today = rows.select("symbol", "session_key").distinct().withColumn("today", F.to_date(F.lit("2024-01-26")))
    found = tallies.answered(tallies.read(s, place), today, last=10, **SMALL)
    return found.select("qid", "symbol", "session_key", "n", "k", "estimate", "ci_low", "ci_high", "low_sample", "refused", "n1", "k1", "n2", "k2", "n_recent", "k_recent")


_SPLIT = "count(*) filter (rn * 2 <= total) as n1, cast(coalesce(sum(success::int) filter (rn * 2 <= total), 0) as bigint) as k1, count(*) filter (rn * 2 > total) as n2, cast(coalesce(sum(success::int) filter (rn * 2 > total), 0) as bigint) as k2, count(*) filter (rn > total - 10) as n_recent, cast(coalesce(sum(success::int) filter (rn > total - 10), 0) as bigint) as k_recent"
register("sweep_stored", stored_sweep, oracle.hits(oracle.BATTERY, span="trade_date < date '2024-01-26'") + f"select * from ({oracle.counted('qid, symbol, session_key', **SMALL)}) join (select qid, symbol, session_key, {_SPLIT} from hits group by all) using (qid, symbol, session_key)")
register("target_ladder", *ask(envelope.ladder(lambda r: catalog.orb_target_hit(15, r), _TARGETS), [named(oracle.OUTCOMES["orb_target_hit"], f"r={r}", success=oracle.OUTCOMES["orb_target_hit"].success.replace(">= 1", f">= {r}")) for r in _TARGETS]))
register("bench_battery", *ask(catalog.BATTERY, oracle.BATTERY))

# The store.
register("coverage", lambda s, d: lookups.coverage(features(s, d)), f"with {oracle.features()} select symbol, session_key, count(*) as sessions, min(trade_date) as first_day, max(trade_date) as last_day from feat group by symbol, session_key")
_NOW = 1706572800000
register("freshness", lambda s, d: lookups.freshness(stored_bars(s, d), _NOW, classed(s, d).select("symbol").union(s.createDataFrame([("quiet",)], "symbol string"))), f"with {oracle.BARS} select 'quiet' as symbol, null as last_ts, 'none' as class union all select symbol, max(ts) as last_ts, case when {_NOW} - max(ts) <= 26 * 3600000 then 'fresh' when {_NOW} - max(ts) <= 7 * 86400000 then 'aging' else 'stale' end as class from bars group by symbol")
register("fingerprint", lambda s, d: lookups.fingerprint(stored_bars(s, d), features(s, d), "2024a"), f"with {oracle.features()} select substr(sha256(concat_ws(':', (select cast(count(*) as varchar) from bars), (select cast(max(ts) as varchar) from bars), (select cast(count(*) as varchar) from feat), (select cast(max(trade_date) as varchar) from feat), '2024a', '1')), 1, 12) as fingerprint")



def provenance(s: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(s, d)
    calendar = key_windows(s, bars, "ny").select("symbol", "trade_date")
    return lookups.provenance(lookups.fingerprint(bars, features(s, d), "2024a"), calendar, "1", {"outcome": "gapFill", "since": None}).drop("calendar_version")


register("provenance", provenance, SQL["fingerprint"].replace(" as fingerprint", " as fingerprint, '1' as version, 'gapFill' as outcome, cast(null as varchar) as since"))

# Trades.
FILLS = "fills as (select event_id as fill_id, case when event_type = 'signup' then 'SGN' when event_id % 97 = 0 then 'UNKNOWN' else event_type end as symbol, case when event_id % 2 = 0 then 'buy' else 'sell' end as side, cast(user_id % 5 + 1 as bigint) as quantity, value as price, 0.01 as fee, case when event_id % 89 = 0 then null else epoch_us(ts) // 1000 end as ts from events where event_type in ('purchase', 'signup'))"
NAMES = [("SGN", "signup")]


def fills(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").filter(F.col("event_type").isin("purchase", "signup"))
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts) div 1000")
    symbol = F.when(F.col("event_type") == "signup", "SGN").when(F.col("event_id") % 97 == 0, "UNKNOWN").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("fill_id"), symbol.alias("symbol"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("user_id") % 5 + 1).cast("long").alias("quantity"), F.col("value").alias("price"), F.lit(0.01).alias("fee"), F.when(F.col("event_id") % 89 != 0, ms).alias("ts"))


def dated_fills(s: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(s, d)
    # The bars' own last days have no windows, so some fills are out of range.
    ends = calendars.spans(bars).select("symbol", F.date_sub("last", 3).alias("end"))
    known = key_windows(s, bars, "ny").join(ends, "symbol").filter("trade_date < end").drop("end")
    return trades.dated(fills(s, d), known, s.createDataFrame(NAMES, "symbol string, store_symbol string"))


_NY = f"nyw as (select w.* from ({oracle.window_rows(('ny', *oracle.SESSIONS['ny']))}) w join spans using (symbol) where trade_date < b - 3)"
_DATED = f"{_NY}, {FILLS}, named as (select *, case when symbol = 'SGN' then 'signup' else symbol end as store_symbol from fills), dated as (select n.*, (select min(w.trade_date) from nyw w where w.symbol = n.store_symbol and w.end_ts > n.ts) as trade_date from named n), ok as (select *, case when store_symbol not in (select symbol from nyw) then 'unmapped' when ts is null then 'no_time' when trade_date is null then 'out_of_range' end as skipped from dated)"
DATED = f"{oracle.BARS}, {oracle.DAYS}, {_DATED}"
# First in, first out: unit u of the buys meets unit u of the sells.
LOTS = "good as (select *, row_number() over (partition by store_symbol order by ts, fill_id) as seq, sum(quantity) over (partition by store_symbol, side order by ts, fill_id) as upto from ok where skipped is null), lots as (select b.store_symbol as symbol, case when b.seq > s.seq then b.trade_date else s.trade_date end as trade_date, (s.price - b.price) * (least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity)) - (b.fee / b.quantity + s.fee / s.quantity) * (least(b.upto, s.upto) - greatest(b.upto - b.quantity, s.upto - s.quantity)) as pnl from good b join good s on b.store_symbol = s.store_symbol and b.side = 'buy' and s.side = 'sell' and b.upto > s.upto - s.quantity and s.upto > b.upto - b.quantity)"
TAGGED = "day_pnl as (select trade_date, sum(pnl) as pnl from lots group by trade_date), traded as (select distinct trade_date from good), tagged as (select trade_date as date, 'TRADED' as event from traded union all select trade_date, case when round(pnl, 6) > 0 then 'TRADED_WIN' else 'TRADED_LOSS' end from day_pnl where round(pnl, 6) <> 0)"


def good_fills(s: SparkSession, d: str) -> DataFrame:
    return dated_fills(s, d).filter("skipped is null").drop("symbol").withColumnRenamed("store_symbol", "symbol")


def trade_tags(s: SparkSession, d: str) -> DataFrame:
    return trades.tags(trades.day_results(good_fills(s, d)).withColumn("pnl", F.round("pnl", 6)))


register("trades_dating", lambda s, d: dated_fills(s, d).select("fill_id", "store_symbol", "trade_date", "skipped"), f"with {DATED} select fill_id, store_symbol, case when skipped is null then trade_date end as trade_date, skipped from ok")
register("trades_skips", lambda s, d: trades.skips(dated_fills(s, d)), f"with {DATED} select count(*) as fills, count(*) filter (skipped is null) as used, " + ", ".join(f"count(*) filter (skipped = '{r}') as {r}" for r in ("unmapped", "no_time", "out_of_range")) + " from ok")
register("trades_fifo_pnl", lambda s, d: trades.realised(good_fills(s, d)).groupBy("symbol", "trade_date").agg(F.round(F.sum("pnl"), 4).alias("pnl")), f"with {DATED}, {LOTS} select symbol, trade_date, round(sum(pnl), 4) as pnl from lots group by symbol, trade_date")
register("trades_tags", trade_tags, f"with {DATED}, {LOTS}, {TAGGED} select * from tagged")
register("trades_summary", lambda s, d: trades.tag_summary(trade_tags(s, d)), f"with {DATED}, {LOTS}, {TAGGED} select event, count(distinct date) as days, min(date) as first_day, max(date) as last_day from tagged group by event")


def trades_conditioned(s: SparkSession, d: str) -> DataFrame:
    rows = envelope.with_events(features(s, d), trade_tags(s, d), ["TRADED", "TRADED_WIN"])
    return envelope.sweep(rows, [Preset("q", catalog.event_occurs("TRADED_WIN"), catalog.event_day("TRADED"))], **SMALL)


register("trades_conditioned", trades_conditioned, f"with {oracle.features()}, {_DATED}, {LOTS}, {TAGGED}, hits as (select 'q' as qid, symbol, session_key, trade_date in (select date from tagged where event = 'TRADED_WIN') as success from feat where complete and trade_date in (select date from tagged where event = 'TRADED')) " + oracle.counted(_Q, **SMALL))

# Streams, run until their source is used up.
register("stream_bars", lambda s, d: monitor.replayed_bars(s, d), f"with {oracle.BARS} select symbol, ts, open, high, low, close, volume from bars")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    bars = stored_bars(s, d)
    return monitor.replayed_sessions(s, bars, key_windows(s, bars, "ny"))


register("stream_sessions", stream_sessions, f"with {oracle.assigned('ny')} select symbol, session_key, trade_date, count(*) as bar_count, max(high) as high, min(low) as low, sum(volume) as volume from inside group by symbol, session_key, trade_date")
_DEVELOPING = 1706184000000  # 2024-01-25 12:00 UTC


def live_source(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    """A stream of all bars in two parts: first those before a time, where one symbol lags behind by days, then the rest and the first ones again with other prices."""
    place = shared_folder(s, "live")
    bars = stored_bars(s, d).withColumns({"tf": F.lit("15m"), "source": F.lit("feed")})
    early = F.col("ts") < F.when(F.col("symbol") == "click", _DEVELOPING - 5 * 86_400_000).otherwise(_DEVELOPING - 86_400_000)
    first = bars.filter(early)
    first.coalesce(1).write.parquet(f"{place}/landed/part=1")
    again = first.withColumn("close", F.col("close") + 1000)
    bars.filter(~early).unionByName(again).coalesce(1).write.parquet(f"{place}/landed/part=2")
    stream = s.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/landed/*")
    return stream, place


def stream_unseen(s: SparkSession, d: str) -> DataFrame:
    stream, place = live_source(s, d)
    monitor.run(stream, lambda batch, n: monitor.append_unseen(batch, n, f"{place}/bars") and None, f"{place}/state")
    return monitor.before(s, f"{place}/bars", 2**62, stream.schema).select("symbol", "tf", "ts", "open", "close")


register("stream_unseen", stream_unseen, f"with {oracle.BARS} select symbol, '15m' as tf, ts, open, close from bars")


def stream_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Every bar comes twice; one of each is left."""
    place = shared_folder(s, "twice")
    bars = stored_bars(s, d).withColumn("tf", F.lit("15m"))
    bars.union(bars).write.parquet(f"{place}/landed")
    stream = monitor.stream_dedupe(s.readStream.schema(bars.schema).parquet(f"{place}/landed"))
    monitor.run(stream, lambda batch, n: monitor.put(batch, f"{place}/bars", n), f"{place}/state")
    return monitor.before(s, f"{place}/bars", 2**62, stream.schema).select("symbol", "tf", "ts", "open", "close")


register("stream_dedupe", stream_dedupe, f"with {oracle.BARS} select symbol, '15m' as tf, ts, open, close from bars")
_GREEN, _FILLS, _HIGH = Preset("green-rate", catalog.close_green()), Preset("gap-fill", catalog.gap_fill()), Preset("prev-range", catalog.touch_prev("high"))
_UP, _BROKE = Preset("up-gap", catalog.gap_fill(), catalog.gap_side("up")), Preset("broke", catalog.close_green(), "or60_first_break = 'up' and not coalesce(inside_day, false)")
_AFTER_CPI, _CPI = Preset("after-cpi", catalog.close_green(), "prev_ev_cpi"), Preset("no-cpi", catalog.gap_fill(), "not ev_opex")
#: Two thresholds of one question, one symbol's and one session's own, and questions about events.
_WATCHES = [Watch(_GREEN, least=0.45, n_least=5), Watch(_GREEN, most=0.55, n_least=8), Watch(_FILLS, least=0.3, n_least=5), Watch(_HIGH, symbol="click", least=0.2, n_least=3), Watch(_HIGH, session_key="overnight", least=0.9, most=0.7, n_least=3), Watch(_UP, least=0.1, n_least=2), Watch(_BROKE, least=0.1, n_least=2), Watch(_AFTER_CPI, least=0.0, n_least=1), Watch(_CPI, least=0.0, n_least=1000)]
_ASK_WATCHES = [named(GREEN_SQL, "green-rate"), named(FILL_SQL, "gap-fill"), named(oracle.OUTCOMES["touch_prev_high"], "prev-range"), named(FILL_SQL, "up-gap", where="gap_dir = 'up'"), named(GREEN_SQL, "broke", where="or60_first_break = 'up' and inside_day is distinct from true"), named(GREEN_SQL, "after-cpi", where="prev_ev_cpi"), named(FILL_SQL, "no-cpi", where="not ev_opex")]
_LIVE_KEYS = ("utc", "overnight", "ny")


def watched(s: SparkSession, d: str) -> str:
    """The folder of a watch over the stream of bars at a time inside the UTC and the overnight session; New York's has not begun."""
    stream, place = live_source(s, d)
    bars, union = stored_bars(s, d), lambda make: reduce(DataFrame.unionByName, map(make, _LIVE_KEYS))
    calendar = kept(union(lambda k: key_windows(s, bars, k)), "windows")
    past = kept(union(lambda k: with_events(s, d, k)), "past")
    own = kept(derive.own_features(union(lambda k: stored_assigned(s, d, k))), "own-features")
    known = live.history(past, own, calendar, _WATCHES, place, "of the store")
    live.watch(stream.filter(F.col("ts") < _DEVELOPING), place, calendar, known, _WATCHES, oracle.BAR_MS, event_rows(s), clock=lambda: _DEVELOPING, refuse=2)
    return place


_LIVE_COLUMNS = [*derive.KEYS, "bar_count", "open", "high", "low", "close", "gap_pct", "gap_dir", "gap_filled", "gap_fill_min", "touched_prev_high", "touch_prev_low_min", "open_pos_prev_range", "range_vs_atr", "vol_vs_avg20", "prev_green_streak", "prev_red_streak", "inside_day", "nr7", "ib_break", "or60_first_break", "or60_ext_up_r", "fvg_above", "fvg_below", "complete", "prev_ev_cpi"]
_TODAY = "trade_date = date '2024-01-25'"
_LIVE = {k: f"(with {oracle.with_events(k, _DEVELOPING)} select * from ev where {_TODAY})" for k in ("utc", "overnight")}
register("stream_developing", lambda s, d: live.last_features(s, watched(s, d)).select(*_LIVE_COLUMNS), " union all ".join(f"select {', '.join(_LIVE_COLUMNS)} from {x}" for x in _LIVE.values()))
_ROW = "select '{}' as watch_id, '{}' as qid, {} as w_symbol, {} as w_session, {} as least, {} as most, {} as n_least"
_SAID = lambda x: "null" if x is None else f"'{x}'"
_WATCH_ROWS = " union all ".join(_ROW.format(w.id, w.question.name, _SAID(w.symbol), _SAID(w.session_key), _SAID(w.least), _SAID(w.most), w.n_least) for w in _WATCHES)
_FITS = "case qid when 'up-gap' then coalesce(gap_dir = 'up', false) when 'broke' then coalesce(or60_first_break = 'up' and inside_day is distinct from true, false) when 'after-cpi' then prev_ev_cpi when 'no-cpi' then not ev_opex else true end"
_SEEN = {k: "(" + oracle.hits(_ASK_WATCHES, k, f"trade_date < {at}") + "select qid, symbol, session_key, count(*) as n, cast(sum(success::int) as bigint) as k, count(*) filter (rn * 2 <= total) as n1, cast(coalesce(sum(success::int) filter (rn * 2 <= total), 0) as bigint) as k1 from hits group by all)" for k, at in (("utc", "date '2024-01-25'"), ("overnight", "date '2024-01-25'"), ("ny", "(select max(f.trade_date) from feat f where f.symbol = ev.symbol)"))}
_STATES = f"""with watches as ({_WATCH_ROWS}),
live as ({" union all by name ".join(f"select symbol, session_key, trade_date, gap_dir, or60_first_break, inside_day, prev_ev_cpi, ev_opex from {x}" for x in _LIVE.values())}),
over as (select distinct symbol, 'ny' as session_key, max(trade_date) over (partition by symbol) as trade_date from (with {oracle.features("ny")} select * from feat)),
seen as ({" union all by name ".join(f"select * from {x}" for x in _SEEN.values())}),
stood as (select watch_id, qid, symbol, session_key, trade_date, case when {_FITS} then 'active' else 'forming' end as phase, least, most, n_least from live, watches where coalesce(w_symbol, symbol) = symbol and coalesce(w_session, session_key) = session_key union all select watch_id, qid, symbol, session_key, trade_date, 'resolved', least, most, n_least from over, watches where coalesce(w_symbol, symbol) = symbol and coalesce(w_session, session_key) = session_key),
states as (select stood.*, coalesce(n, 0) as n, coalesce(k, 0) as k, n1, k1, case when n >= 2 then {oracle.r6("k / n", 4)} end as estimate, case when n >= 2 then {oracle.r6(oracle.wilson("n", "k")[1], 4)} end as ci_low, case when n >= 2 then {oracle.r6(oracle.wilson("n", "k")[2], 4)} end as ci_high from stood left join seen using (qid, symbol, session_key))"""


def stream_phases(s: SparkSession, d: str) -> DataFrame:
    """The board after the last batch: phases, dates and answers of all watches, switched off as the stream has ended."""
    board = live.Board(s, f"{watched(s, d)}/board").newest()
    return board.select("watch_id", "symbol", "session_key", "trade_date", "phase", "n", "k", "estimate", "ci_low", "ci_high", "enabled")


register("stream_phases", stream_phases, f"{_STATES} select watch_id, symbol, session_key, trade_date, phase, n, k, estimate, ci_low, ci_high, false as enabled from states")


def stream_alerts(s: SparkSession, d: str) -> DataFrame:
    """All alerts with what they rest on, as they are replayed."""
    found = monitor.replay(s, f"{watched(s, d)}/ledger", n=500)
    return found.select("id", "watch_id", "symbol", "session_key", "trade_date", "snapshot.n", "snapshot.k", "snapshot.n1", "snapshot.k1", "snapshot.least", "snapshot.most", "snapshot.fingerprint", F.unix_millis("fired_at").alias("fired_ms"), "text")


_FIRED = "phase = 'active' and n >= n_least and (coalesce(estimate >= cast(least as double), false) or coalesce(estimate <= cast(most as double), false))"
register("stream_alerts", stream_alerts, f"{_STATES} select symbol || '|' || session_key || '|2024-01-25|' || substr(sha256(qid || '|' || coalesce(least, '-') || '|' || coalesce(most, '-')), 1, 12) as id, watch_id, symbol, session_key, trade_date, n, k, n1, k1, cast(least as double) as least, cast(most as double) as most, 'of the store' as fingerprint, {_DEVELOPING} as fired_ms, symbol || ' ' || session_key || ' 2024-01-25 ' || watch_id || printf(': %.4f [%.4f, %.4f], N=%d. Past frequency, not advice.', estimate, ci_low, ci_high, n) as text from states where {_FIRED}")

# Files: bars written in each landed form and read again.
_BAR = ["symbol", "ts", "open", "high", "low", "close", "volume"]
_BARS_SQL = f"with {oracle.BARS} select {', '.join(_BAR)} from bars"


def each_symbol(s: SparkSession, d: str, rows: DataFrame, kind: str, read: Callable[[SparkSession, str, object], DataFrame], **options: str) -> DataFrame:
    """rows written to a folder for each symbol; all folders are read in one scan, symbols from their paths."""
    place = shared_folder(s, "landed")
    rows.write.options(**options).partitionBy("symbol").format(kind).save(place)
    return readers.checked(read(s, f"{place}/symbol=*", readers.in_path()))


def documents(rows: DataFrame, element: str, wrap: str = "to_json({})") -> DataFrame:
    """A JSON document for each symbol and day: the list of element over its bars."""
    day = rows.withColumn("day", F.floor(F.col("ts") / 86_400_000)).groupBy("symbol", "day").agg(F.expr(f"collect_list({element})").alias("x"))
    return day.select("symbol", F.expr(wrap.format("x")).alias("value"))


def _lines(unit: str) -> list[str]:
    return [f"{unit} as t", "open", "high", "low", "close", "cast(volume as bigint) as volume"]


_DOC = {"maxRecordsPerFile": "1"}
_TEXTS = "cast(open as string), cast(high as string), cast(low as string), cast(close as string), cast(volume as string)"
_MAPPING = {"ts": "when", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "contract": "front"}
_NAMED = "open as o", "high as h", "low as l", "close as c", "volume as v", "contract as front"
_AFTER, _UNTIL = 1704585600000, 1705881600000
_READS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_csv_bars": lambda s, d: each_symbol(s, d, stored_bars(s, d).selectExpr("symbol", "ts as when", *_NAMED), "csv", lambda s, p, x: readers.read_csv_bars(s, p, x, _MAPPING), header="true"),
    "read_csv_bars_iso": lambda s, d: each_symbol(s, d, stored_bars(s, d).selectExpr("symbol", "date_format(timestamp_millis(ts), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as when", *_NAMED), "csv", lambda s, p, x: readers.read_csv_bars(s, p, x, _MAPPING, "iso", ";"), header="true", sep=";"),
    "read_kline_csv": lambda s, d: each_symbol(s, d, stored_bars(s, d).selectExpr("symbol", *_lines("ts * 1000"), "'x' as more"), "csv", readers.read_kline_csv),
    "read_kline_json": lambda s, d: each_symbol(s, d, documents(stored_bars(s, d), f"array(cast(ts as string), {_TEXTS})"), "text", readers.read_kline_json, **_DOC),
    "read_candles_json": lambda s, d: each_symbol(s, d, documents(stored_bars(s, d), "array(cast(ts div 1000 as string), cast(low as string), cast(high as string), cast(open as string), cast(close as string), cast(volume as string))"), "text", readers.read_candles_json, **_DOC),
    "read_bars_page_json": lambda s, d: each_symbol(s, d, documents(stored_bars(s, d), "named_struct('t', date_format(timestamp_millis(ts), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'o', open, 'h', high, 'l', low, 'c', close, 'v', volume)", "to_json(named_struct('bars', {}, 'next_page_token', 'x'))"), "text", readers.read_bars_page_json, **_DOC),
    "read_ohlcv_csv_ns": lambda s, d: each_symbol(s, d, stored_bars(s, d).selectExpr("symbol", "ts * 1000000 as ts_event", "open", "high", "low", "close", "volume"), "csv", readers.read_ohlcv_csv_ns, header="true"),
    "read_candle_objects_json": lambda s, d: each_symbol(s, d, documents(stored_bars(s, d), "named_struct('ts', ts, 'open', open, 'high', high, 'low', low, 'close', close, 'volume', volume)"), "text", readers.read_candle_objects_json, **_DOC),
    "read_rates_json": lambda s, d: each_symbol(s, d, documents(stored_bars(s, d), "named_struct('timestamp', ts, 'open', open, 'high', high, 'low', low, 'close', close, 'volume', volume)"), "text", readers.read_rates_json, **_DOC),
    "read_candle_short_json": lambda s, d: each_symbol(s, d, documents(stored_bars(s, d), "named_struct('t', ts, 'o', cast(open as string), 'h', cast(high as string), 'l', cast(low as string), 'c', cast(close as string), 'v', cast(volume as string))"), "text", readers.read_candle_short_json, **_DOC),
}
for _name, _read in _READS.items():
    register(_name, lambda s, d, f=_read: f(s, d).select(*_BAR), _BARS_SQL)


def flat_minutes(s: SparkSession, d: str) -> DataFrame:
    place = shared_folder(s, "flat")
    stored_bars(s, d).selectExpr("symbol as ticker", "ts * 1000000 as window_start", "open", "high", "low", "close", "cast(volume as bigint) as volume").write.option("header", True).option("compression", "gzip").csv(place)
    return readers.checked(readers.read_flat_minutes(s, place)).select(*_BAR)


register("read_flat_minutes", flat_minutes, _BARS_SQL)


def bars_between(s: SparkSession, d: str) -> DataFrame:
    rows = stored_bars(s, d).selectExpr("symbol", "ts as when", *_NAMED)
    return each_symbol(s, d, rows, "csv", lambda s, p, x: readers.read_csv_bars(s, p, x, _MAPPING, since=_AFTER, until=_UNTIL), header="true").select(*_BAR)


register("read_csv_bars_since_until", bars_between, f"{_BARS_SQL} where ts > {_AFTER} and ts <= {_UNTIL}")


def stored(s: SparkSession, d: str) -> str:
    """A store of bars, loaded twice: the second load replaces the first."""
    place = shared_folder(s, "store")
    bars = stored_bars(s, d).withColumn("tf", F.lit("15m"))
    ingest.append(bars.withColumn("close", F.col("close") + 1), place)
    ingest.resync(bars, place)
    return place


register("read_bars_resynced", lambda s, d: readers.read_bars(s, stored(s, d)).select("tf", "year", *_BAR), f"with {oracle.BARS} select '15m' as tf, cast(year(make_timestamp(ts * 1000)) as integer) as year, {', '.join(_BAR)} from bars")
register("read_partition", lambda s, d: readers.read_partition(s, stored(s, d), "click", "15m", [2024]).select(*_BAR), f"{_BARS_SQL} where symbol = 'click' and year(make_timestamp(ts * 1000)) = 2024")


def calendar_file(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A calendar whose holidays are the Mondays that have events, and half days their Fridays."""
    place = shared_folder(s, "calendar")
    day = s.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("date")).distinct()
    named_day = "named_struct('date', cast(date as string), 'name', 'day')"
    day.selectExpr(f"collect_list(case when weekday(date) = 0 then {named_day} end) as holidays", "collect_list(case when weekday(date) = 4 then named_struct('date', cast(date as string), 'name', 'short', 'close', '13:00') end) as halfDays").selectExpr("'X' as exchange", "'v1' as version", "named_struct('from', '2024-01-01', 'to', '2024-12-31') as coverage", "holidays", "halfDays").coalesce(1).write.json(place)
    return readers.read_calendar(s, place)


_DATES = "(select distinct cast(ts as date) as date from events)"
register("read_calendar_holidays", lambda s, d: calendar_file(s, d)[0].select("exchange", "date", "name"), f"select 'X' as exchange, date, 'day' as name from {_DATES} where isodow(date) = 1")
register("read_calendar_half_days", lambda s, d: calendar_file(s, d)[1].select("exchange", "date", "close_min", "version", "covered_from", "covered_to"), f"select 'X' as exchange, date, cast(780 as integer) as close_min, 'v1' as version, date '2024-01-01' as covered_from, date '2024-12-31' as covered_to from {_DATES} where isodow(date) = 5")


def event_files(s: SparkSession, d: str) -> DataFrame:
    place = shared_folder(s, "events")
    e = s.read.parquet(f"{d}/events.parquet").filter("event_id % 3 = 0")
    e.groupBy(F.col("event_type").alias("event")).agg(F.array_sort(F.collect_set(F.to_date("ts").cast("string"))).alias("dates")).selectExpr("event", "'v2' as version", "array('a', 'b') as sources", "named_struct('from', '2024-01-01', 'to', '2024-01-31') as coverage", "dates").write.options(**_DOC).json(place)
    return readers.read_events(s, place).drop("sources")


register("read_events", event_files, "select distinct cast(ts as date) as date, event_type as event, cast(null as varchar) as detail, 'v2' as version, date '2024-01-01' as covered_from, date '2024-01-31' as covered_to from events where event_id % 3 = 0")


def fills_file(s: SparkSession, d: str) -> DataFrame:
    place = shared_folder(s, "fills")
    bad = F.when(F.col("fill_id") % 11 == 0, "n/a").otherwise(F.col("price").cast("string"))
    fills(s, d).select("symbol", "side", "quantity", bad.alias("price"), "fee", F.col("ts").alias("executedAt")).write.option("header", True).csv(place)
    return readers.read_fills_csv(s, place).groupBy("symbol", "side", "ok").agg(F.count("*").alias("fills"), F.sum("quantity").alias("quantity"), F.count("ts").alias("timed"))


register("read_fills_csv", fills_file, f"with {FILLS} select symbol, side, fill_id % 11 <> 0 as ok, count(*) as fills, cast(sum(quantity) as double) as quantity, count(ts) as timed from fills group by all")


def replaced_features(s: SparkSession, d: str) -> DataFrame:
    """Features of two sessions, of which one is replaced."""
    place = shared_folder(s, "features")
    sinks.replace_features(features(s, d).unionByName(features(s, d, "ny")), place)
    sinks.replace_features(features(s, d).withColumn("bar_count", F.lit(-1)), place)
    return s.read.parquet(place).select(*derive.KEYS, "bar_count")


register("replace_features", replaced_features, f"with {oracle.features('utc')} select symbol, 'utc' as session_key, trade_date, cast(-1 as integer) as bar_count from feat union all select * from (with {oracle.features('ny')} select symbol, session_key, trade_date, bar_count from feat)")


def exported(s: SparkSession, d: str, kind: str) -> DataFrame:
    place = shared_folder(s, "export")
    sinks.export(stored_bars(s, d), place, kind, ["click", "signup"], ["symbol", "ts"])
    return s.read.schema(stored_bars(s, d).schema).option("header", True).format(kind).load(place).select(*_BAR)


for _kind in ("csv", "parquet"):
    register(f"export_{_kind}", lambda s, d, k=_kind: exported(s, d, k), f"{_BARS_SQL} where symbol in ('click', 'signup')")


def exported_matches(s: SparkSession, d: str) -> DataFrame:
    place = shared_folder(s, "matches")
    sinks.export_matches(features(s, d), hits(s, d, GAP), place, "parquet")
    return s.read.parquet(place).select("session_id", "gap_dir", "outcome_success", "outcome_value")


register("export_matches", exported_matches, oracle.hits(ASK_GAP) + "select session_id, gap_dir, success as outcome_success, value as outcome_value from hits join feat using (session_id)")


def artefacts(s: SparkSession, d: str, part: str) -> DataFrame:
    place = shared_folder(s, "artefacts")
    sinks.sweep_artefacts(with_events(s, d), catalog.BATTERY, place)
    return s.read.json(f"{place}/{part}")


register("sweep_artefacts", lambda s, d: artefacts(s, d, "results").select("qid", "symbol", "session_key", "n", "k"), oracle.hits(oracle.BATTERY) + f"select {_Q}, count(*) as n, cast(sum(case when success then 1 else 0 end) as bigint) as k from hits group by {_Q}")
register("sweep_manifest", lambda s, d: artefacts(s, d, "manifest").select("symbol", "session_key", "sessions", F.to_date("first_day").alias("first_day"), F.to_date("last_day").alias("last_day")), SQL["coverage"])


def replaced_tags(s: SparkSession, d: str) -> DataFrame:
    place = shared_folder(s, "tags")
    sinks.replace_tags(event_rows(s).unionByName(trade_tags(s, d).withColumn("date", F.date_sub("date", 400))), place)
    sinks.replace_tags(trade_tags(s, d), place)
    return s.read.parquet(place).select("date", "event")


register("replace_tags", replaced_tags, f"with {DATED}, {LOTS}, {TAGGED} select * from tagged union all select * from (values " + ", ".join(f"(date '{x}', '{name}')" for name, days in oracle.EVENTS for x in days) + ") as v(date, event)")


def alert_lines(s: SparkSession, d: str) -> DataFrame:
    place = shared_folder(s, "alerts")
    found = s.read.parquet(f"{watched(s, d)}/ledger")
    sinks.append_alerts(found.select("id", "symbol", "text"), place)
    return s.read.schema("id string, symbol string, text string").json(place).join(found.select("id", F.col("text").alias("fired")), "id").filter(F.col("text") == F.col("fired")).select("symbol", F.split("id", r"\|")[2].alias("day")).distinct()


register("alert_lines", alert_lines, f"select symbol, cast(trade_date as varchar) as day from ({SQL['stream_alerts']}) group by all")
