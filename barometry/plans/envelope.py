"""Conditional frequencies: P(outcome | conditions) over feature rows, many questions in one pass."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import RECENT, REFUSE, WARN, estimate, wilson
from .catalog import Outcome, Preset

SERIES = ["symbol", "session_key"]
QUANTILES = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
#: Matched sessions that one answer lists, at most.
MOST_LISTED = 500


def with_events(rows: DataFrame, events: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with ev_<name> and whether the series' next and previous session, complete or not, has that event.

    events (date, event) is joined once, as a set per date; repeated rows don't multiply.
    """
    sets = events.groupBy(F.col("date").alias("trade_date")).agg(F.collect_set("event").alias("events"))
    out = rows.join(sets, "trade_date", "left")
    w = Window.partitionBy(*SERIES).orderBy("trade_date")
    for name in names:
        out = out.withColumn(f"ev_{name.lower()}", F.coalesce(F.array_contains("events", name), F.lit(False)))
    for name in names:
        here = f"ev_{name.lower()}"
        out = out.withColumn(f"next_{here}", F.coalesce(F.lead(here).over(w), F.lit(False))).withColumn(f"prev_{here}", F.coalesce(F.lag(here).over(w), F.lit(False)))
    return out.drop("events")


def matching(rows: DataFrame, presets: Sequence[Preset], since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per question and matching session: qid, success, value, grp.

    A condition that is null counts as false, so does a null success. All questions are
    evaluated in one scan: each row is listed for the questions it matches.
    """
    base = rows.filter("complete")
    if since:
        base = base.filter(F.col("trade_date") >= F.lit(since).cast("date"))
    if until:
        base = base.filter(F.col("trade_date") <= F.lit(until).cast("date"))

    def answer(p: Preset) -> Column:
        fits = F.expr(f"coalesce({p.outcome.eligible}, false) and coalesce({p.where}, false)")
        hit = F.struct(F.lit(p.name).alias("qid"), F.expr(f"coalesce({p.outcome.success}, false)").alias("success"), F.expr(p.outcome.value).cast("double").alias("value"), F.expr(p.by).cast("string").alias("grp"))
        return F.when(fits, hit)

    return base.select(*SERIES, "trade_date", "session_id", F.explode(F.filter(F.array(*map(answer, presets)), lambda x: x.isNotNull())).alias("q")).select("q.*", *SERIES, "trade_date", "session_id")


def matched(rows: DataFrame, presets: Sequence[Preset], since: str | None = None, until: str | None = None) -> DataFrame:
    """matching(), with the session's place in time (rn of total)."""
    hits = matching(rows, presets, since, until)
    own = Window.partitionBy("qid", *SERIES)
    return hits.withColumn("rn", F.row_number().over(own.orderBy("trade_date"))).withColumn("total", F.count("*").over(own))


_SHOWN = ("n", "k", "estimate", "ci_low", "ci_high", "low_sample", "refused")


def guarded(out: DataFrame, warn: int = WARN, refuse: int = REFUSE, force: bool = False) -> DataFrame:
    """out with the estimate of its n and k, its interval and the guards; a refused estimate is null, unless forced."""
    shown = F.lit(True) if force else F.col("n") >= refuse
    made = {name: F.when(shown, c) for c, name in zip(estimate("n", "k"), ("estimate", "ci_low", "ci_high"), strict=True)}
    return out.withColumns(made | {"low_sample": F.col("n") < warn, "refused": F.col("n") < refuse})


def counted(hits: DataFrame, keys: Sequence[str], **guards) -> DataFrame:
    """n, k, estimate, its interval and the guards (warn, refuse, force) by keys; counts stay where the estimate is refused."""
    return guarded(hits.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("success").cast("long")).alias("k")), **guards).select(*keys, *_SHOWN)


KEYS = ["qid", *SERIES]


def stability(hits: DataFrame) -> DataFrame:
    """Counts of the earlier and the later half (the middle session is later), and whether their intervals overlap."""
    early = F.col("rn") * 2 <= F.col("total")
    part = lambda name, cond: [F.count(F.when(cond, 1)).alias(f"n{name}"), F.coalesce(F.sum(F.when(cond, F.col("success").cast("long"))), F.lit(0)).alias(f"k{name}")]
    out = hits.groupBy(*KEYS).agg(*part("1", early), *part("2", ~early))
    (a, b), (c, d) = wilson(F.col("n1"), F.col("k1")), wilson(F.col("n2"), F.col("k2"))
    return out.withColumn("agree", F.when((F.col("n1") > 0) & (F.col("n2") > 0), (a <= d) & (c <= b)))


def recency(hits: DataFrame, last: int = RECENT) -> DataFrame:
    """Counts of the last sessions against all, where there are more; diverges: the intervals are apart."""
    out = hits.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.col("success").cast("long")).alias("k"), F.count(F.when(F.col("rn") > F.col("total") - last, 1)).alias("n_recent"), F.sum(F.when(F.col("rn") > F.col("total") - last, F.col("success").cast("long"))).alias("k_recent")).filter(F.col("n") > last)
    (a, b), (c, d) = wilson(F.col("n"), F.col("k")), wilson(F.col("n_recent"), F.col("k_recent"))
    return out.withColumn("diverges", (a > d) | (c > b))


def per_year(hits: DataFrame) -> DataFrame:
    return counted(hits.withColumn("year", F.year("trade_date")), [*KEYS, "year"], force=True).drop("low_sample", "refused")


def distribution(hits: DataFrame) -> DataFrame:
    """Count, mean and exact quantiles of the non-null values of all eligible sessions."""
    q = F.percentile("value", F.array(*map(F.lit, QUANTILES.values())))
    out = hits.groupBy(*KEYS).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), q.alias("q"))
    return out.select(*KEYS, "count", "mean", *(F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)))


def groups(hits: DataFrame) -> DataFrame:
    """Counts by the question's group field; a null group is called NULL. Small groups keep their estimate and carry the guards."""
    return counted(hits.withColumn("grp", F.coalesce("grp", F.lit("NULL"))), [*KEYS, "grp"], force=True)


def latest(hits: DataFrame, n: int = 25) -> DataFrame:
    """Each question's n newest matching sessions; n is brought into 0 (none) to MOST_LISTED."""
    n = min(max(n, 0), MOST_LISTED)
    return hits.filter(F.col("rn") > F.col("total") - n).select(*KEYS, "session_id", "trade_date", "success", "value")


def envelope(rows: DataFrame, outcome: Outcome, where: str = "true", by: str = "cast(null as string)", last: int = RECENT, **counts) -> DataFrame:
    """One row per series: n, k, estimate and guards, with structs for stability, recency and distribution and arrays for years and groups.

    The matches are aggregated once for all numbers of a series, and once more by year and by
    group (one aggregation over grouping sets).
    """
    hits = matched(rows, [Preset("q", outcome, where, by)]).withColumn("year", F.year("trade_date")).withColumn("grp", F.coalesce("grp", F.lit("NULL")))
    success = F.col("success").cast("long")
    part = lambda name, cond: [F.count(F.when(cond, 1)).alias(f"n{name}"), F.coalesce(F.sum(F.when(cond, success)), F.lit(0)).alias(f"k{name}")]
    early, recent = F.col("rn") * 2 <= F.col("total"), F.col("rn") > F.col("total") - last
    q = F.percentile("value", F.array(*map(F.lit, QUANTILES.values())))
    one = hits.groupBy(*SERIES).agg(*part("", F.lit(True)), *part("1", early), *part("2", ~early), *part("_recent", recent), F.count("value").alias("count"), F.avg("value").alias("mean"), q.alias("q"))
    bounds = {name: wilson(F.col(f"n{name}"), F.col(f"k{name}")) for name in ("", "1", "2", "_recent")}
    overlap = lambda a, b: (bounds[a][0] <= bounds[b][1]) & (bounds[b][0] <= bounds[a][1])
    agree = F.when((F.col("n1") > 0) & (F.col("n2") > 0), overlap("1", "2"))
    structs = {
        "stability": F.struct("n1", "k1", "n2", "k2", agree.alias("agree")),
        "recency": F.when(F.col("n") > last, F.struct("n_recent", "k_recent", (~overlap("", "_recent")).alias("diverges"))),
        "distribution": F.struct("count", "mean", *(F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES))),
    }
    out = guarded(one, **counts).select(*SERIES, *_SHOWN, *(c.alias(name) for name, c in structs.items()))
    sets = hits.groupingSets([[F.col("year"), *map(F.col, SERIES)], [F.col("grp"), *map(F.col, SERIES)]], F.col("year"), F.col("grp"), *map(F.col, SERIES)).agg(F.grouping("year").alias("by_group"), F.count("*").alias("n"), F.sum(success).alias("k"))
    shown = guarded(sets, **(counts | {"force": True}))
    listed = lambda key, cond: F.array_sort(F.collect_list(F.when(cond, F.struct(key, "n", "k", "estimate", "ci_low", "ci_high", *([] if key == "year" else ["low_sample", "refused"])))))
    lists = shown.groupBy(*SERIES).agg(listed("year", F.col("by_group") == 0).alias("years"), listed("grp", F.col("by_group") == 1).alias("groups"))
    return out.join(lists, SERIES)


def sweep(rows: DataFrame, presets: Sequence[Preset], **counts) -> DataFrame:
    """Every question for every series, in one pass."""
    return counted(matched(rows, presets), KEYS, **counts)


def ladder(make, targets: Sequence[float]) -> list[Preset]:
    """One question per target, e.g. ladder(lambda r: orb_target_hit(15, r), [0.5, 1])."""
    return [Preset(f"r={r}", make(r)) for r in targets]


def marker(rows: DataFrame, outcome: Outcome) -> DataFrame:
    """session_id with the price level, minute, verb and side that answer an outcome: the level it is about, and when it was reached (null: never). Outcomes without a level give no rows."""
    kind, w = outcome.mark or ("none", 0)
    reached = lambda minute, yes, no: F.when(F.col(minute).isNotNull(), yes).otherwise(no)
    own = lambda level, verb, side: (F.col(level), F.col(f"{level}_time_min"), F.lit(verb), F.lit(side))
    prior = lambda level, side: (F.col(f"prev_{level}"), F.col(f"touch_prev_{level}_min"), reached(f"touch_prev_{level}_min", "touched", "not touched"), F.lit(side))
    if kind == "gap":
        side = F.when(F.col("gap_dir") == "down", "above").otherwise("below")
        level, minute, verb = F.when(F.col("gap_dir").isin("up", "down"), F.col("prev_close")), F.col("gap_fill_min"), reached("gap_fill_min", "filled", "not filled")
    elif kind == "or":
        first = F.col(f"or{w}_first_break")
        side = F.when(first == "down", "below").otherwise("above")
        level, minute = F.when(first == "down", F.col(f"or{w}_low")).otherwise(F.col(f"or{w}_high")), F.when(first != "none", F.col(f"or{w}_break_min"))
        verb = F.when(first == "up", "broke up").when(first == "down", "broke down").otherwise("range held")
    elif kind in ("prev_high", "prev_low"):
        level, minute, verb, side = prior(kind.removeprefix("prev_"), "above" if kind == "prev_high" else "below")
    elif kind in ("high", "low"):
        level, minute, verb, side = own(kind, kind, "above" if kind == "high" else "below")
    else:
        level, minute, verb, side = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(""), F.lit("")
    return rows.select("session_id", level.alias("level"), minute.alias("minute"), verb.alias("verb"), side.alias("side")).filter("level is not null")
