"""Positions of pattern matches in text columns, and texts rewritten at them, with Spark's functions only.

``split`` and ``regexp_extract_all`` walk the same leftmost non-overlapping matches; the
lengths of the gaps and of the matches add up to code point positions.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose positions are summed up together.
RUN = 256
SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def found(text: Column, pattern: str, kind: str, rank: int, group: int = 0) -> Column:
    """All matches of pattern as an array of SPAN's structs; value is the group's text. The pattern never matches nothing.

    Positions are summed up within runs of RUN matches and over the runs, so that no long array
    is copied for each match.
    """
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc.out, one).alias("out"))

    def placed(matches: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(RUN)), lambda i: F.slice(matches, i + 1, RUN))
        width = lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["whole"]))
        inside = lambda r, at: F.aggregate(r, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc.out)
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(runs, first, lambda acc, r: F.struct((acc.at + width(r)).alias("at"), F.array_append(acc.out, inside(r, acc.at)).alias("out")), lambda acc: F.flatten(acc.out))

    def zipped(whole: Column) -> Column:
        value = whole if group == 0 else every(group)
        matches = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
        return F.when(F.size(whole) > 0, bound(matches, placed)).otherwise(none)

    return F.when(text.rlike(pattern), bound(every(0), zipped)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def rewritten(text: Column, spans: Column) -> Column:
    """text with each span (sorted, disjoint structs of start, end, new) replaced by its new text."""
    before = lambda i: F.coalesce(F.get(spans, i - 1).end, F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s.start - before(i)), s.new))
    rest = F.substring(text, F.coalesce(F.get(spans, F.size(spans) - 1).end, F.lit(0)) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
