"""Outcomes, predicates and presets over feature rows, as SQL boolean texts that Spark parses.

An outcome is (eligibility, success, value). Anything that a SQL expression over the feature
columns can say can be a condition; these functions only name the common ones.
"""

import math
from collections.abc import Callable
from typing import NamedTuple

from ..operators.derive import IB_WINDOW


#: Feature columns that answers are grouped by, and all others that conditions name; each is a column.
GROUPABLE = ("dow", "month", "year", "green", "gap_dir", "gap_bucket", "gap_filled", "open_above_prev_high", "open_below_prev_low", "touched_prev_high", "touched_prev_low", "closed_above_prev_high", "closed_below_prev_low", "inside_day", "outside_day", "nr4", "nr7", "bull_engulf", "bear_engulf", "doji", "high_before_low", "prev_day_green", "prev_inside_day", "prev_nr7", "prev_doji", "is_roll_day", "is_half_day", "fvg_above", "fvg_below", "ib_break")
NUMERIC = ("range_pct", "ret_oc_pct", "gap_pct", "abs_gap_pct", "gap_fill_min", "open_pos_prev_range", "touch_prev_high_min", "touch_prev_low_min", "high_time_min", "low_time_min", "atr14_pct", "range_vs_atr", "vol_vs_avg20", "prev_green_streak", "prev_red_streak", "next_range_pct", "next_range_vs_atr")


class Outcome(NamedTuple):
    """mark: what a session's answer is shown at (a level and a minute), by kind and opening-range window; none for rates without a level."""

    eligible: str
    success: str
    value: str = "cast(null as double)"
    unit: str = ""
    mark: tuple[str, int] | None = None


def _first_break(w: int, side: str) -> str:
    return f"or{w}_first_break in ('up', 'down')" if side == "any" else f"or{w}_first_break = '{side}'"


def gap_fill() -> Outcome:
    return Outcome("gap_dir in ('up', 'down')", "gap_filled", "cast(gap_fill_min as double)", "minutes", ("gap", 0))


def gap_hold(side: str = "any") -> Outcome:
    eligible = "gap_dir in ('up', 'down')" if side == "any" else f"gap_dir = '{side}'"
    return Outcome(eligible, "not coalesce(gap_filled, false) and ((gap_dir = 'up' and green) or (gap_dir = 'down' and close < open))", mark=("gap", 0))


def gap_reversal() -> Outcome:
    return Outcome("gap_filled", "gap_reversed", mark=("gap", 0))


def close_green() -> Outcome:
    return Outcome("true", "green", "ret_oc_pct", "%")


def next_close_green() -> Outcome:
    return Outcome("next_green is not null", "next_green", "next_ret_oc_pct", "%")


def orb_break(w: int, side: str = "any") -> Outcome:
    return Outcome(f"or{w}_high is not null", _first_break(w, side), f"cast(or{w}_break_min as double)", "minutes", ("or", w))


def orb_false_break(w: int, side: str = "any") -> Outcome:
    return Outcome(_first_break(w, side), f"or{w}_false_break", mark=("or", w))


def orb_target_hit(w: int, r: float, side: str = "any") -> Outcome:
    reach = f"case or{w}_first_break when 'up' then or{w}_ext_up_r when 'down' then or{w}_ext_dn_r end"
    return Outcome(_first_break(w, side), f"({reach}) >= {r}", reach, "r", ("or", w))


def ib_extension(r: float, side: str = "any", w: int = IB_WINDOW) -> Outcome:
    reach = {"up": f"coalesce(or{w}_ext_up_r, 0) >= {r}", "down": f"coalesce(or{w}_ext_dn_r, 0) >= {r}"}
    if side == "any":
        return Outcome("ib_break <> 'none'", " or ".join(reach.values()), mark=("or", w))
    return Outcome(f"ib_break in ('single_{side}', 'double')", reach[side], mark=("or", w))


def touch_prev(level: str) -> Outcome:
    return Outcome(f"prev_{level} is not null", f"touched_prev_{level}", f"cast(touch_prev_{level}_min as double)", "minutes", (f"prev_{level}", 0))


def break_hold_prev(level: str) -> Outcome:
    return Outcome(f"touched_prev_{level}", "closed_above_prev_high" if level == "high" else "closed_below_prev_low", mark=(f"prev_{level}", 0))


def extreme_before(level: str, minutes: int) -> Outcome:
    return Outcome(f"{level}_time_min is not null", f"{level}_time_min < {minutes}", f"cast({level}_time_min as double)", "minutes", (level, 0))


def hit(field: str, op: str, x: float) -> Outcome:
    sign = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<"}[op]
    return Outcome(f"{field} is not null", f"{field} {sign} {x}", f"cast({field} as double)")


def event_occurs(event: str) -> Outcome:
    return Outcome("true", event_day(event))


def event_day(event: str) -> str:
    return f"ev_{event.lower()}"


def day_before_event(event: str) -> str:
    return f"next_ev_{event.lower()}"


def day_after_event(event: str) -> str:
    return f"prev_ev_{event.lower()}"


def no_gap() -> str:
    return "(gap_dir = 'none' or gap_dir is null)"


def gap_side(side: str) -> str:
    return f"gap_dir = '{side}'"


def orb_broke(w: int, side: str = "any") -> str:
    return _first_break(w, side)


def orb_false_broke(w: int, side: str = "any") -> str:
    return f"({_first_break(w, side)} and or{w}_false_break)"


def orb_broke_both(w: int) -> str:
    return f"or{w}_broke_both"


def ib_single_break(side: str = "any") -> str:
    return "ib_break in ('single_up', 'single_down')" if side == "any" else f"ib_break = 'single_{side}'"


def ib_double_break() -> str:
    return "ib_break = 'double'"


def ib_no_break() -> str:
    return "ib_break = 'none'"


def streak(color: str, n: int) -> str:
    return f"prev_{color}_streak >= {n}"


def fvg_present(side: str) -> str:
    return f"fvg_{side}"


def negated(condition: str) -> str:
    """The complement: rows where condition is false or null."""
    return f"(not coalesce({condition}, false))"


OUTCOMES = {
    "gap_fill": gap_fill(), "gap_hold": gap_hold(), "gap_reversal": gap_reversal(), "close_green": close_green(), "next_close_green": next_close_green(), "orb_break": orb_break(15, "up"), "orb_false_break": orb_false_break(30), "orb_target_hit": orb_target_hit(15, 1), "ib_extension": ib_extension(0.5),
    "touch_prev_high": touch_prev("high"), "touch_prev_low": touch_prev("low"), "break_hold_prev_high": break_hold_prev("high"), "break_hold_prev_low": break_hold_prev("low"), "time_of_high_before": extreme_before("high", 60), "time_of_low_before": extreme_before("low", 60), "hit": hit("range_vs_atr", "gte", 1), "event_occurs": event_occurs("OPEX"),
}


class Preset(NamedTuple):
    """A named question: its outcome, its condition, and a field to group by (null: none)."""

    name: str
    outcome: Outcome
    where: str = "true"
    by: str = "cast(null as string)"


class Param(NamedTuple):
    """A preset's parameter: its default (none: unused unless given), the condition it adds (none: it goes to the outcome), and its values if they are few."""

    default: float | str | None = None
    where: str | None = None
    values: tuple[str, ...] = ()


class Kind(NamedTuple):
    """What a preset asks; make takes the parameters that go to the outcome."""

    make: Callable[..., Outcome]
    where: str | Callable[..., str] = "true"
    by: str = "cast(null as string)"
    params: dict[str, Param] = {}


_SIDES, _ANY = ("up", "down"), ("up", "down", "any")
_GAP = {"min_gap_pct": Param(None, "abs_gap_pct >= {}"), "max_gap_pct": Param(None, "abs_gap_pct <= {}"), "dir": Param(None, "gap_dir = '{}'", _SIDES)}
_OR = {"window": Param(15), "dir": Param("any", None, _ANY)}
_OPEN = {"min_open_pos": Param(None, "open_pos_prev_range >= {}"), "max_open_pos": Param(None, "open_pos_prev_range <= {}")}
_MULTIPLE = {"r": Param(1)}


def _some(params: dict[str, Param], *names: str) -> dict[str, Param]:
    return {k: params[k] for k in names}


def _orb(window: float, dir: str) -> Outcome:
    return orb_break(int(window), dir)


#: The questions that users ask by name, with their parameters and defaults; fixed values.
KINDS = {
    "gap-fill": Kind(gap_fill, params=_GAP),
    "gap-fill-by-size": Kind(gap_fill, by="gap_bucket", params=_some(_GAP, "dir")),
    "gap-fill-by-direction": Kind(gap_fill, by="gap_dir", params=_some(_GAP, "min_gap_pct")),
    "gap-fill-by-weekday": Kind(gap_fill, by="dow", params=_some(_GAP, "dir", "min_gap_pct")),
    "gap-fill-time": Kind(gap_fill, params=_some(_GAP, "dir", "min_gap_pct")),
    "gap-reversal": Kind(gap_reversal, params=_some(_GAP, "dir", "min_gap_pct")),
    "gap-and-go": Kind(lambda dir: gap_hold(dir), by="gap_bucket", params={"dir": Param("any", None, _ANY)} | _some(_GAP, "min_gap_pct")),
    "orb": Kind(_orb, params=_OR),
    "orb-by-direction": Kind(_orb, by="dow", params=_OR | {"dir": Param("up", None, _SIDES)}),
    "orb-time-to-break": Kind(_orb, params=_OR),
    "orb-false-break": Kind(lambda window, dir: orb_false_break(int(window), dir), params=_OR),
    "orb-target": Kind(lambda window, r, dir: orb_target_hit(int(window), r, dir), params=_OR | _MULTIPLE),
    "initial-balance": Kind(close_green, by="ib_break"),
    "ib-extension": Kind(lambda r, dir: ib_extension(r, dir), params=_MULTIPLE | _some(_OR, "dir")),
    "prev-range": Kind(lambda: touch_prev("high"), params=_OPEN),
    "prev-high-touch-by-open": Kind(lambda: touch_prev("high"), by="dow", params=_OPEN | {"min_open_pos": Param(0.5, "open_pos_prev_range >= {}")}),
    "prev-low-touch": Kind(lambda: touch_prev("low"), params=_OPEN | {"max_open_pos": Param(0.5, "open_pos_prev_range <= {}")}),
    "prev-high-break-hold": Kind(lambda: break_hold_prev("high")),
    "prev-low-break-hold": Kind(lambda: break_hold_prev("low")),
    "inside-day": Kind(next_close_green, "inside_day"),
    "outside-day": Kind(next_close_green, "outside_day"),
    "doji-follow-through": Kind(next_close_green, "doji"),
    "engulfing-bull": Kind(next_close_green, "bull_engulf"),
    "engulfing-bear": Kind(next_close_green, "bear_engulf"),
    "nr7-expansion": Kind(lambda r: hit("range_vs_atr", "gte", r), "nr7", params=_MULTIPLE),
    "streak-continuation": Kind(close_green, params={"n": Param(3, "prev_green_streak >= {}")}),
    "streak-reversion": Kind(close_green, params={"n": Param(3, "prev_red_streak >= {}")}),
    "green-rate": Kind(close_green),
    "day-of-week": Kind(close_green, by="dow"),
    "month-of-year": Kind(close_green, by="cast(month as string)"),
    "event-day-fomc": Kind(close_green, event_day("FOMC")),
    "event-day-cpi": Kind(close_green, event_day("CPI")),
    "event-day-nfp": Kind(close_green, event_day("NFP")),
    "event-day-opex": Kind(close_green, event_day("OPEX")),
    "day-before-event": Kind(close_green, lambda event: day_before_event(event), params={"event": Param("OPEX")}),
    "day-after-event": Kind(close_green, lambda event: day_after_event(event), params={"event": Param("OPEX")}),
    "high-time": Kind(lambda within: extreme_before("high", within), params={"within": Param(60)}),
    "low-time": Kind(lambda within: extreme_before("low", within), params={"within": Param(60)}),
    "range-vs-atr": Kind(lambda r: hit("range_vs_atr", "gte", r), params=_MULTIPLE),
    "quiet-then-wild": Kind(lambda r: hit("range_vs_atr", "gte", r), "nr4", params=_MULTIPLE),
    "fvg-below-green": Kind(close_green, fvg_present("below")),
    "fvg-magnet": Kind(gap_fill, params={"dir": Param("up", "gap_dir = '{}'", _SIDES), "side": Param("below", "fvg_{}", ("below", "above"))}),
}


def preset(name: str, **given: float | str) -> Preset:
    """The question called name, with parameters given or at their defaults. Unknown names, parameters and values are errors."""
    if name not in KINDS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(KINDS)}")
    kind = KINDS[name]
    for k, v in given.items():
        if k not in kind.params:
            raise ValueError(f"preset {name!r} has no parameter {k!r}; it has {', '.join(kind.params) or 'none'}")
        values, default = kind.params[k].values, kind.params[k].default
        if values and v not in values:
            raise ValueError(f"{k} of preset {name!r} must be one of {', '.join(values)}")
        if not values and not isinstance(default, str) and (isinstance(v, str) or not math.isfinite(v)):
            raise ValueError(f"{k} of preset {name!r} must be a number")
    used = {k: v for k, v in ({k: p.default for k, p in kind.params.items()} | given).items() if v is not None}
    own = {k: v for k, v in used.items() if kind.params[k].where is None}
    # A condition made of parameters takes them all; else they go to the outcome.
    where = kind.where(**own) if callable(kind.where) else kind.where
    outcome = kind.make() if callable(kind.where) else kind.make(**own)
    parts = [f"({where})", *(f"({kind.params[k].where.format(v)})" for k, v in used.items() if kind.params[k].where)]
    return Preset(name, outcome, " and ".join(parts), kind.by)


PRESETS = tuple(preset(name) for name in KINDS)
#: The reference battery of ten questions.
BATTERY = (
    Preset("gap-fill", gap_fill()),
    Preset("gap-fill-conditioned", gap_fill(), "gap_pct between 0.1 and 0.8 and dow = 'Tue'"),
    Preset("gap-fill-by-weekday", gap_fill(), by="dow"),
    Preset("orb-15m", orb_break(15, "up")),
    Preset("orb-target-ladder", orb_target_hit(15, 1)),
    Preset("ib-extension", ib_extension(0.5)),
    Preset("prev-high-touch", touch_prev("high"), "open_pos_prev_range >= 0.5"),
    Preset("streak-reversion", close_green(), streak("red", 2)),
    Preset("event-day", close_green(), event_day("OPEX")),
    Preset("time-of-high", extreme_before("high", 60)),
)
