"""The registered queries' meaning as DuckDB SQL: one chain of common table expressions.

Nothing here is made from the library's own expressions: outcomes, conditions and presets are
written out as SQL, from their definitions.
"""

from typing import NamedTuple

Z = 1.959963984540054
OR_WINDOWS = (5, 10, 15, 30, 60)
BAR_MS = 900_000
SESSIONS = {"utc": (0, 1440, "UTC", False, True), "ny": (570, 960, "America/New_York", False, False), "overnight": (1080, 1020, "America/New_York", True, False)}
HOLIDAYS = ("2024-01-01", "2024-01-15")
HALF_DAYS = (("2024-01-12", 780), ("2024-01-19", 780))
EVENTS = (("OPEX", ("2024-01-19",)), ("FOMC", ("2024-01-10", "2024-01-31")), ("CPI", ("2024-01-11", "2024-01-24")), ("NFP", ("2024-01-05", "2024-01-26")))


def r6(x: str, places: int = 6) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


TICKS = """ticks as (select event_type as symbol, epoch_us(ts) // 1000 as ts, ts as moment, cast(1000000 + sum((case when event_id % 2 = 0 then 1 else -1 end) * (cast(round(value * 100) as bigint) // 5)) over (partition by event_type order by ts) as double) / 100.0 as px from events)"""
BARS = f"""{TICKS},
bars as (select symbol, ts // {BAR_MS} * {BAR_MS} as ts, arg_min(px, moment) as open, max(px) as high, min(px) as low, arg_max(px, moment) as close, cast(count(*) as double) as volume, case when ts // {BAR_MS} * {BAR_MS} < 1705363200000 then 'F4' else 'G4' end as contract from ticks group by all)"""


#: Sessions of each exchange: key, start and end minute, zone, overnight, every day.
EXCHANGES = {
    "NYSE": (("rth", 570, 960, "America/New_York", False, False),),
    "CME": (("rth", 570, 960, "America/New_York", False, False), ("globex", 1080, 1020, "America/New_York", True, False)),
    "CRYPTO": (("utc", 0, 1440, "UTC", False, True), ("ny", 570, 960, "America/New_York", False, True)),
    "FX": (("sydney", 1260, 360, "UTC", True, False), ("tokyo", 0, 540, "UTC", False, False), ("london", 420, 960, "UTC", False, False), ("newyork", 720, 1260, "UTC", False, False)),
}
DAYS = """spans as (select symbol, cast(date '1970-01-01' + cast(min(ts) // 86400000 as integer) - 3 as date) as a, cast(date '1970-01-01' + cast(max(ts) // 86400000 as integer) + 2 as date) as b from bars group by symbol),
days as (select symbol, cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from spans)"""


def window_rows(definition: tuple, half_days: bool = False, which: str = "true") -> str:
    """The windows of one session definition on days, as a select; an every-day session ignores holidays too."""
    key, start, end, tz, overnight, every = definition
    wall = lambda day, minute: f"epoch_ms(timezone('{tz}', cast({day} as timestamp) + interval ({minute}) minute))"
    open_days = "true" if every else f"isodow(d) <= 5 and d not in ({', '.join(f"date '{x}'" for x in HOLIDAYS)})"
    early = f"case d {' '.join(f"when date '{d}' then {m}" for d, m in HALF_DAYS)} end" if half_days else "cast(null as integer)"
    return f"""select symbol, session_key, trade_date, start_ts, least(full_end, coalesce(early, full_end)) as end_ts, close_min is not null as is_half_day from
(select symbol, '{key}' as session_key, d as trade_date, {wall(f"d - {int(overnight)}", start)} as start_ts, {wall("d", end)} as full_end, {early} as close_min, case when {early} is null then null else {wall("d", early)} end as early from days where {open_days} and {which})
where least(full_end, coalesce(early, full_end)) > start_ts"""


def windows(key: str, half_days: bool = False) -> str:
    return f"{DAYS},\nwins as ({window_rows((key, *SESSIONS[key]), half_days)})"


def assigned(key: str, until: int | None = None) -> str:
    """CTEs up to inside, the bars in sessions; with until, as known at that time."""
    seen = "" if until is None else f" and b.ts < {until}"
    return f"""{BARS},
{windows(key)},
inside as (select b.*, w.session_key, w.trade_date, w.start_ts, w.end_ts, w.is_half_day from bars b join wins w on b.symbol = w.symbol and b.ts >= w.start_ts and b.ts < w.end_ts{seen})"""


K = "symbol, session_key, trade_date"


def stats(key: str, until: int | None = None) -> str:
    first = [f"max(high) filter (ts < start_ts + {w * 60000}) as h{w}, min(low) filter (ts < start_ts + {w * 60000}) as l{w}, count(*) filter (ts < start_ts + {w * 60000}) as bars{w}" for w in OR_WINDOWS]
    second = [f"min(i.ts) filter (i.ts >= i.start_ts + {w * 60000} and i.high > h{w}) as up{w}, min(i.ts) filter (i.ts >= i.start_ts + {w * 60000} and i.low < l{w}) as dn{w}, max(i.high) filter (i.ts >= i.start_ts + {w * 60000}) as ph{w}, min(i.low) filter (i.ts >= i.start_ts + {w * 60000}) as pl{w}" for w in OR_WINDOWS]
    return f"""{assigned(key, until)},
s1 as (select {K}, start_ts, end_ts, is_half_day, cast(count(*) as integer) as bar_count, min(ts) as first_ts, max(ts) as last_ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume, arg_min(contract, ts) as contract_first, arg_max(contract, ts) as contract_last, {", ".join(first)} from inside group by {K}, start_ts, end_ts, is_half_day),
s2 as (select {K}, min(i.ts) filter (i.high >= s1.high) as high_ts, min(i.ts) filter (i.low <= s1.low) as low_ts, {", ".join(second)} from inside i join s1 using ({K}) group by {K}),
stats as (select * from s1 join s2 using ({K}))"""


def ranges() -> str:
    out = []
    for w in OR_WINDOWS:
        ok = f"bars{w} > 0 and bar_count > bars{w}"
        first = f"(case when up{w} is not null and (dn{w} is null or up{w} <= dn{w}) then 'up' when dn{w} is not null then 'down' else 'none' end)"
        width = f"(h{w} - l{w})"
        values = {
            "high": f"h{w}", "low": f"l{w}", "range": width, "first_break": first,
            "break_min": f"cast(floor((case {first} when 'up' then up{w} when 'down' then dn{w} end - start_ts) / 60000) as integer)",
            "false_break": f"case {first} when 'up' then close < h{w} when 'down' then close > l{w} end",
            "broke_both": f"up{w} is not null and dn{w} is not null",
            "ext_up_r": f"case when up{w} is not null and {width} > 0 then {r6(f'greatest(0.0, ph{w} - h{w}) / {width}')} end",
            "ext_dn_r": f"case when dn{w} is not null and {width} > 0 then {r6(f'greatest(0.0, l{w} - pl{w}) / {width}')} end",
        }
        out += [f"case when {ok} then {v} end as or{w}_{name}" for name, v in values.items()]
    ib = "case when bars60 > 0 and bar_count > bars60 then case when up60 is not null and dn60 is not null then 'double' when up60 is not null then 'single_up' when dn60 is not null then 'single_down' else 'none' end end as ib_break"
    return ", ".join([*out, ib])


def features(key: str = "utc", until: int | None = None) -> str:
    """CTEs up to feat, one row per session with every feature."""
    w = "over (partition by symbol, session_key order by trade_date)"
    before = lambda n: f"over (partition by symbol, session_key order by trade_date rows between {n} preceding and 1 preceding)"
    upto = "over (partition by symbol, session_key order by trade_date rows between unbounded preceding and current row)"
    lag = lambda x: f"lag({x}) {w}"
    full = lambda f, x, n: f"case when count({x}) {before(n)} = {n} then {f}({x}) {before(n)} end"
    return f"""{stats(key, until)},
a1 as (select *, {ranges()}, row_number() {w} as idx, {lag("open")} as p_open, {lag("high")} as p_high, {lag("low")} as p_low, {lag("close")} as p_close, {lag("contract_last")} as p_contract, first_ts <= start_ts + 1800000 and last_ts >= end_ts - 1800000 - {BAR_MS} as complete from stats),
a2 as (select *, idx > 1 and (coalesce(contract_first <> p_contract, false) or coalesce(contract_first <> contract_last, false)) as is_roll_day from a1),
a3 as (select *, idx > 1 and not is_roll_day as use_prev, case when idx > 1 and not is_roll_day then p_close end as prev_close, case when idx > 1 and not is_roll_day then p_high end as prev_high, case when idx > 1 and not is_roll_day then p_low end as prev_low from a2),
a4 as (select *, high - low as range_abs, close > open as green, (prev_high + prev_low) / 2.0 as prev_mid, prev_high - prev_low as prev_range, case when prev_close <> 0 then open - prev_close end as gap_abs, case when prev_close <> 0 then 100.0 * (open - prev_close) / prev_close end as gap_raw, case when prev_close is null or prev_close = 0 then null when open - prev_close > 0 then 'up' when open - prev_close < 0 then 'down' else 'none' end as gap_dir from a3),
a5 as (select *, {r6("100.0 * range_abs / nullif(open, 0)")} as range_pct, {r6("100.0 * (close - open) / nullif(open, 0)")} as ret_oc_pct, {r6("gap_raw")} as gap_pct, {r6("abs(gap_raw)")} as abs_gap_pct, case when gap_dir in ('up', 'down') then case when abs(gap_raw) < 0.15 then 'xs' when abs(gap_raw) < 0.3 then 's' when abs(gap_raw) < 0.75 then 'm' when abs(gap_raw) < 1.5 then 'l' else 'xl' end end as gap_bucket,
  case when prev_range > 0 then {r6("(open - prev_low) / prev_range")} end as open_pos_prev_range, open > prev_high as open_above_prev_high, open < prev_low as open_below_prev_low, close > prev_high as closed_above_prev_high, close < prev_low as closed_below_prev_low,
  case when use_prev then high <= prev_high and low >= prev_low end as inside_day, case when use_prev then high > prev_high and low < prev_low end as outside_day, range_abs > 0 and abs(close - open) <= 0.1 * range_abs as doji,
  case when use_prev then p_close < p_open and green and open <= p_close and close >= p_open end as bull_engulf, case when use_prev then p_close > p_open and close <= open and open >= p_close and close <= p_open end as bear_engulf, p_close > p_open as prev_day_green,
  case when prev_close is not null then greatest(range_abs, abs(high - prev_close), abs(low - prev_close)) else range_abs end as tr from a4),
a6 as (select *, {full("avg", "tr", 14)} as atr, {full("avg", "volume", 20)} as avg20, {full("min", "range_abs", 3)} as low3, {full("min", "range_abs", 6)} as low6, idx - coalesce(max(case when not green then idx end) {upto}, 0) as green_run, idx - coalesce(max(case when not close < open then idx end) {upto}, 0) as red_run from a5),
a7 as (select *, coalesce(range_abs < low3, false) as nr4, coalesce(range_abs < low6, false) as nr7, {r6("100.0 * atr / nullif(prev_close, 0)")} as atr14_pct, {r6("range_abs / nullif(atr, 0)")} as range_vs_atr, {r6("volume / nullif(avg20, 0)")} as vol_vs_avg20, coalesce({lag("green_run")}, 0) as prev_green_streak, coalesce({lag("red_run")}, 0) as prev_red_streak from a6),
a8 as (select *, case when use_prev then {lag("inside_day")} end as prev_inside_day, case when use_prev then {lag("nr7")} end as prev_nr7, case when use_prev then {lag("doji")} end as prev_doji, lead(green) {w} as next_green, lead(ret_oc_pct) {w} as next_ret_oc_pct, lead(range_pct) {w} as next_range_pct, lead(range_vs_atr) {w} as next_range_vs_atr,
  symbol || '|' || session_key || '|' || cast(trade_date as varchar) as session_id, strftime(trade_date, '%a') as dow, cast(month(trade_date) as integer) as month, cast(year(trade_date) as integer) as year, cast(floor((high_ts - start_ts) / 60000) as integer) as high_time_min, cast(floor((low_ts - start_ts) / 60000) as integer) as low_time_min, high_ts < low_ts as high_before_low from a7),
scan as (select {K}, min(i.ts) filter (i.low <= f.prev_close) as fill_up, min(i.ts) filter (i.high >= f.prev_close) as fill_dn, min(i.ts) filter (i.high >= f.prev_high) as touch_h, min(i.ts) filter (i.low <= f.prev_low) as touch_l from inside i join (select {K}, prev_close, prev_high, prev_low from a8 where gap_dir is not null) f using ({K}) group by {K}),
a9 as (select a8.*, case when gap_dir in ('up', 'down') then case gap_dir when 'up' then fill_up else fill_dn end is not null end as gap_filled, case when gap_dir in ('up', 'down') then cast(floor((case gap_dir when 'up' then fill_up else fill_dn end - start_ts) / 60000) as integer) end as gap_fill_min,
  case when gap_dir in ('up', 'down') then case gap_dir when 'up' then fill_up else fill_dn end is not null and case gap_dir when 'up' then close < prev_close else close > prev_close end end as gap_reversed,
  case when gap_dir is not null then touch_h is not null end as touched_prev_high, case when gap_dir is not null then touch_l is not null end as touched_prev_low, case when gap_dir is not null then cast(floor((touch_h - start_ts) / 60000) as integer) end as touch_prev_high_min, case when gap_dir is not null then cast(floor((touch_l - start_ts) / 60000) as integer) end as touch_prev_low_min
  from a8 left join scan using ({K})),
zones as (select c.symbol, c.session_key, c.idx as born, case when c.low > o.high then o.high else c.high end as lo, case when c.low > o.high then c.low else o.low end as hi, c.low > o.high as bull from a9 c join a9 o on c.symbol = o.symbol and c.session_key = o.session_key and o.idx = c.idx - 2 where c.low > o.high or c.high < o.low),
lives as (select z.symbol, z.session_key, z.born, z.lo, z.hi, z.bull, min(p.idx) as pierced from zones z left join a9 p on p.symbol = z.symbol and p.session_key = z.session_key and p.idx > z.born and case when z.bull then p.low <= z.lo else p.high >= z.hi end group by all),
feat as (select a9.*, exists (select 1 from lives v where v.symbol = a9.symbol and v.session_key = a9.session_key and not v.bull and v.born < a9.idx and a9.idx <= coalesce(v.pierced, 1000000) and v.lo > a9.open) as fvg_above, exists (select 1 from lives v where v.symbol = a9.symbol and v.session_key = a9.session_key and v.bull and v.born < a9.idx and a9.idx <= coalesce(v.pierced, 1000000) and v.hi < a9.open) as fvg_below from a9)"""


def with_events(key: str = "utc", until: int | None = None) -> str:
    w = "over (partition by symbol, session_key order by trade_date)"
    here = [f"trade_date in ({', '.join(f"date '{d}'" for d in days)}) as ev_{name.lower()}" for name, days in EVENTS]
    near = [f"coalesce({f}(ev_{name.lower()}) {w}, false) as {side}_ev_{name.lower()}" for name, _ in EVENTS for f, side in (("lead", "next"), ("lag", "prev"))]
    return f"{features(key, until)},\nev0 as (select *, {', '.join(here)} from feat),\nev as (select *, {', '.join(near)} from ev0)"


def wilson(n: str, k: str) -> tuple[str, str, str]:
    p = f"(cast({k} as double) / {n})"
    below, centre = f"(1.0 + {Z * Z} / {n})", f"({p} + {Z * Z} / (2.0 * {n}))"
    wide = f"({Z} * sqrt({p} * (1.0 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n})))"
    return p, f"greatest(0.0, ({centre} - {wide}) / {below})", f"least(1.0, ({centre} + {wide}) / {below})"


class Ask(NamedTuple):
    """A question: who counts, who succeeds, the value, the condition and the group."""

    name: str
    eligible: str
    success: str
    value: str = "null"
    where: str = "true"
    by: str = "null"


_GAPPED = "gap_dir is not null and gap_dir <> 'none'"
_UP_REACH = "case when or15_first_break = 'up' then or15_ext_up_r when or15_first_break = 'down' then or15_ext_dn_r end"
_BROKE_15 = "or15_first_break = 'up' or or15_first_break = 'down'"
_GREEN = ("true", "close > open", "ret_oc_pct")
_NEXT = ("next_green is not null", "next_green", "next_ret_oc_pct")
_FILL = (_GAPPED, "gap_filled", "gap_fill_min")
_HIGH = ("prev_high is not null", "touched_prev_high", "touch_prev_high_min")
_LOW = ("prev_low is not null", "touched_prev_low", "touch_prev_low_min")
_EXPANDS = ("range_vs_atr is not null", "range_vs_atr >= 1", "range_vs_atr")
_ORB_ANY = ("or15_high is not null", _BROKE_15, "or15_break_min")
_ORB_UP = ("or15_high is not null", "or15_first_break = 'up'", "or15_break_min")
_HELD_GAP = (_GAPPED, "gap_filled = false and case gap_dir when 'up' then close > open else close < open end")

OUTCOMES = {
    "gap_fill": Ask("gap_fill", *_FILL),
    "gap_hold": Ask("gap_hold", *_HELD_GAP),
    "gap_reversal": Ask("gap_reversal", "gap_filled", "gap_reversed"),
    "close_green": Ask("close_green", *_GREEN),
    "next_close_green": Ask("next_close_green", *_NEXT),
    "orb_break": Ask("orb_break", *_ORB_UP),
    "orb_false_break": Ask("orb_false_break", "or30_first_break <> 'none'", "or30_false_break"),
    "orb_target_hit": Ask("orb_target_hit", _BROKE_15, f"{_UP_REACH} >= 1", _UP_REACH),
    "ib_extension": Ask("ib_extension", "ib_break <> 'none'", "coalesce(or60_ext_up_r, 0) >= 0.5 or coalesce(or60_ext_dn_r, 0) >= 0.5"),
    "touch_prev_high": Ask("touch_prev_high", *_HIGH),
    "touch_prev_low": Ask("touch_prev_low", *_LOW),
    "break_hold_prev_high": Ask("break_hold_prev_high", "touched_prev_high", "close > prev_high"),
    "break_hold_prev_low": Ask("break_hold_prev_low", "touched_prev_low", "close < prev_low"),
    "time_of_high_before": Ask("time_of_high_before", "high_time_min is not null", "high_time_min < 60", "high_time_min"),
    "time_of_low_before": Ask("time_of_low_before", "low_time_min is not null", "low_time_min < 60", "low_time_min"),
    "hit": Ask("hit", *_EXPANDS),
    "event_occurs": Ask("event_occurs", "true", "ev_opex"),
}
PRESETS = (
    Ask("gap-fill", *_FILL),
    Ask("gap-fill-by-size", *_FILL, by="gap_bucket"),
    Ask("gap-fill-by-direction", *_FILL, by="gap_dir"),
    Ask("gap-fill-by-weekday", *_FILL, by="dow"),
    Ask("gap-fill-time", *_FILL),
    Ask("gap-reversal", "gap_filled", "gap_reversed"),
    Ask("gap-and-go", *_HELD_GAP, by="gap_bucket"),
    Ask("orb", *_ORB_ANY),
    Ask("orb-by-direction", *_ORB_UP, by="dow"),
    Ask("orb-time-to-break", *_ORB_ANY),
    Ask("orb-false-break", _BROKE_15, "or15_false_break"),
    Ask("orb-target", _BROKE_15, f"{_UP_REACH} >= 1", _UP_REACH),
    Ask("initial-balance", *_GREEN, by="ib_break"),
    Ask("ib-extension", "ib_break <> 'none'", "coalesce(or60_ext_up_r, 0) >= 1 or coalesce(or60_ext_dn_r, 0) >= 1"),
    Ask("prev-range", *_HIGH),
    Ask("prev-high-touch-by-open", *_HIGH, "open_pos_prev_range >= 0.5", "dow"),
    Ask("prev-low-touch", *_LOW, "open_pos_prev_range <= 0.5"),
    Ask("prev-high-break-hold", "touched_prev_high", "close > prev_high"),
    Ask("prev-low-break-hold", "touched_prev_low", "close < prev_low"),
    Ask("inside-day", *_NEXT, "inside_day"),
    Ask("outside-day", *_NEXT, "outside_day"),
    Ask("doji-follow-through", *_NEXT, "doji"),
    Ask("engulfing-bull", *_NEXT, "bull_engulf"),
    Ask("engulfing-bear", *_NEXT, "bear_engulf"),
    Ask("nr7-expansion", *_EXPANDS, "nr7"),
    Ask("streak-continuation", *_GREEN, "prev_green_streak >= 3"),
    Ask("streak-reversion", *_GREEN, "prev_red_streak >= 3"),
    Ask("green-rate", *_GREEN),
    Ask("day-of-week", *_GREEN, by="dow"),
    Ask("month-of-year", *_GREEN, by="month"),
    Ask("event-day-fomc", *_GREEN, "ev_fomc"),
    Ask("event-day-cpi", *_GREEN, "ev_cpi"),
    Ask("event-day-nfp", *_GREEN, "ev_nfp"),
    Ask("event-day-opex", *_GREEN, "ev_opex"),
    Ask("day-before-event", *_GREEN, "next_ev_opex"),
    Ask("day-after-event", *_GREEN, "prev_ev_opex"),
    Ask("high-time", "high_time_min is not null", "high_time_min < 60", "high_time_min"),
    Ask("low-time", "low_time_min is not null", "low_time_min < 60", "low_time_min"),
    Ask("range-vs-atr", *_EXPANDS),
    Ask("quiet-then-wild", *_EXPANDS, "nr4"),
    Ask("fvg-below-green", *_GREEN, "fvg_below"),
    Ask("fvg-magnet", *_FILL, "gap_dir = 'up' and fvg_below"),
)
BATTERY = (
    Ask("gap-fill", *_FILL),
    Ask("gap-fill-conditioned", *_FILL, "gap_pct >= 0.1 and gap_pct <= 0.8 and isodow(trade_date) = 2"),
    Ask("gap-fill-by-weekday", *_FILL, by="dow"),
    Ask("orb-15m", *_ORB_UP),
    Ask("orb-target-ladder", _BROKE_15, f"{_UP_REACH} >= 1", _UP_REACH),
    Ask("ib-extension", "ib_break <> 'none'", "coalesce(or60_ext_up_r, 0) >= 0.5 or coalesce(or60_ext_dn_r, 0) >= 0.5"),
    Ask("prev-high-touch", *_HIGH, "open_pos_prev_range >= 0.5"),
    Ask("streak-reversion", *_GREEN, "prev_red_streak >= 2"),
    Ask("event-day", *_GREEN, "ev_opex"),
    Ask("time-of-high", "high_time_min is not null", "high_time_min < 60", "high_time_min"),
)
#: Presets with other parameters than the defaults: the ones given, and what they ask.
VARIED = (
    ({"name": "gap-fill", "min_gap_pct": 0.05, "max_gap_pct": 0.6, "dir": "down"}, Ask("gap-fill", *_FILL, "abs_gap_pct >= 0.05 and abs_gap_pct <= 0.6 and gap_dir = 'down'")),
    ({"name": "gap-and-go", "dir": "up", "min_gap_pct": 0.02}, Ask("gap-and-go", "gap_dir = 'up'", "gap_filled = false and close > open", where="abs_gap_pct >= 0.02")),
    ({"name": "orb", "window": 30, "dir": "down"}, Ask("orb", "or30_high is not null", "or30_first_break = 'down'", "or30_break_min")),
    ({"name": "orb-false-break", "window": 60, "dir": "up"}, Ask("orb-false-break", "or60_first_break = 'up'", "close < or60_high")),
    ({"name": "orb-target", "window": 15, "r": 0.5, "dir": "down"}, Ask("orb-target", "or15_first_break = 'down'", "or15_ext_dn_r >= 0.5", "or15_ext_dn_r")),
    ({"name": "ib-extension", "r": 0.25, "dir": "up"}, Ask("ib-extension", "ib_break = 'single_up' or ib_break = 'double'", "coalesce(or60_ext_up_r, 0) >= 0.25")),
    ({"name": "prev-range", "min_open_pos": 0.2, "max_open_pos": 0.9}, Ask("prev-range", *_HIGH, "open_pos_prev_range between 0.2 and 0.9")),
    ({"name": "streak-continuation", "n": 1}, Ask("streak-continuation", *_GREEN, "prev_green_streak >= 1")),
    ({"name": "day-after-event", "event": "CPI"}, Ask("day-after-event", *_GREEN, "prev_ev_cpi")),
    ({"name": "day-before-event", "event": "NFP"}, Ask("day-before-event", *_GREEN, "next_ev_nfp")),
    ({"name": "high-time", "within": 120}, Ask("high-time", "high_time_min is not null", "high_time_min < 120", "high_time_min")),
    ({"name": "range-vs-atr", "r": 0.8}, Ask("range-vs-atr", "range_vs_atr is not null", "range_vs_atr >= 0.8", "range_vs_atr")),
    ({"name": "fvg-magnet", "dir": "down", "side": "above"}, Ask("fvg-magnet", *_FILL, "gap_dir = 'down' and fvg_above")),
)


def hits(asked: tuple[Ask, ...] | list[Ask], key: str = "utc", span: str = "true") -> str:
    """CTEs up to hits: a row per question and matching session."""
    one = [f"select '{q.name}' as qid, coalesce({q.success}, false) as success, cast({q.value} as double) as value, cast({q.by} as varchar) as grp, symbol, session_key, trade_date, session_id from ev where complete and {span} and coalesce({q.eligible}, false) and coalesce({q.where}, false)" for q in asked]
    sql = "\nunion all ".join(one)
    return f"""with {with_events(key)},
h0 as ({sql}),
hits as (select *, row_number() over (partition by qid, symbol, session_key order by trade_date) as rn, count(*) over (partition by qid, symbol, session_key) as total from h0)"""


def counted(keys: str, refuse: int = 10, warn: int = 30, source: str = "hits", force: bool = False) -> str:
    p, low, high = (r6(x, 4) for x in wilson("n", "k"))
    shown = [f"case when {'true' if force else f'n >= {refuse}'} then {x} end as {name}" for x, name in ((p, "estimate"), (low, "ci_low"), (high, "ci_high"))]
    return f"select {keys}, n, k, {', '.join(shown)}, n < {warn} as low_sample, n < {refuse} as refused from (select {keys}, count(*) as n, cast(sum(case when success then 1 else 0 end) as bigint) as k from {source} group by {keys})"
