"""Quality rules as weak supervision, in Spark's functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns (at most 3 to the power of the rules, whatever the corpus)
estimates how each rule votes on good and on bad documents; a document's posterior
probability of being good then decides, instead of passing every rule.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

_SPACE = "\t\n\x0b\x0c\r"


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, and the counts that rules read, over each whole text (null: empty).

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier
    line), n_repeat_words (words in 8-word windows found at least twice), n_upper and n_bang.
    """
    text = docs.select(*keep, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = text.select(*keep, "id", "t", F.array_remove(F.split(F.translate("t", _SPACE, "     "), " "), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.translate(x, _SPACE + " ", "") != "").alias("lines"))
    counted = split.select(
        *keep,
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", _SPACE + " ", "")).cast("long").alias("word_chars"),
        _count_of(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        _count_of(F.col("t"), "!").alias("n_bang"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    last = F.size("h") - 8
    windows = counted.withColumn("windows", F.when(last > 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("h", i, 8))))).drop("h")
    # Only texts with a repeated window are sorted to find where.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windows.withColumn("ordered", F.when(twice, F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("windows")
    same = lambda s, k: F.coalesce(F.get("ordered", k).x == s.x, F.lit(False))
    starts = F.array_sort(F.filter(F.transform("ordered", lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s.i).otherwise(-1)), lambda i: i >= 0))
    placed = ordered.withColumn("starts", F.when(F.col("ordered").isNotNull(), starts)).drop("ordered")
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("starts", k + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long")).drop("starts")


@dataclass(frozen=True)
class Rule:
    """bad and good are conditions on measures(); bad wins, neither abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 4 * n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars between 4 * n_words and 9 * n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    Rule("lines", "100 * n_dup_lines > 40 * n_lines", "n_lines >= 3 and 100 * n_dup_lines <= 5 * n_lines"),
    Rule("shouting", "100 * n_upper > 25 * word_chars", "100 * n_upper <= 10 * word_chars"),
    Rule("exclamation", "100 * n_bang > 20 * n_words", "100 * n_bang <= 5 * n_words"),
)


def votes(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows with a column v (array of -1, 0, 1 in the rules' order)."""
    one = lambda r: F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0)
    return rows.withColumn("v", F.array(*map(one, rules)))


#: How rules vote on good (1) and on bad (-1) documents, before any is seen; how the broken rule votes on junk that breaks one.
BELIEF = {1: {-1: 0.002, 0: 0.05, 1: 0.948}, -1: {-1: 0.3, 0: 0.1, 1: 0.6}}
KIND = {-1: 0.9, 0: 0.03, 1: 0.07}
WRONG, PASSED = 0.002, 0.6


def _smooth(counts: dict[int, float], belief: dict[int, float], extra: float) -> dict[int, float]:
    """The votes' shares, with extra documents that vote as believed."""
    total = sum(counts.values()) + extra
    return {x: (counts[x] + extra * belief[x]) / total for x in counts}


def _right(p: dict[int, float], wrong: float) -> dict[int, float]:
    """p with at most wrong bad votes; the other votes keep their shares."""
    bad = min(p[-1], wrong)
    return {x: bad if x == -1 else (1 - bad) * p[x] / (p[0] + p[1]) for x in p}


def _broken(p: dict[int, float], good: dict[int, float], least: float, most: float) -> dict[int, float]:
    """p with bad votes within bounds, such that neither an abstention nor a good vote speaks for junk, and the latter no more than the former."""
    bad = max(good[-1], least, min(p[-1], most))
    none = max(min((1 - bad) * p[0] / (p[0] + p[1]), good[0]), (1 - bad) * good[0] / (good[0] + good[1]))
    return {-1: bad, 0: none, 1: 1 - bad - none}


def fitted(patterns: dict[tuple[int, ...], int], steps: int = 200, strength: float = 0.02, wrong: float = WRONG, passed: float = PASSED) -> dict[tuple[int, ...], float]:
    """Each vote pattern's posterior of being good, by expectation-maximisation from counts.

    Documents are good, junk that may break every rule, or one of as many kinds of junk as
    there are rules, which break that rule and pass the others as good documents do: one class
    of junk alone must take in good documents to explain that most junk passes most rules.
    BELIEF and KIND are the start, and their counts ``strength`` times the documents are added
    in each step. A bad vote is wrong on at most ``wrong`` of the good documents. ``passed`` is
    the share of junk held to break one rule only before any is seen, and the least share at
    which other junk is not caught by a rule; at 0 there are no kinds. In every class of junk a
    better vote never makes a document worse, whatever the counts.
    """
    if not patterns:
        return {}
    rules = range(len(next(iter(patterns))))
    total = sum(patterns.values())
    extra = strength * total
    # Classes: good, broad junk, one kind of junk for each rule.
    start = [0.85, 0.15 * (1 - passed), *(0.15 * passed / len(rules) for _ in rules)]
    share = start
    rest = 1 - BELIEF[1][-1]
    good = [{-1: wrong} | {x: BELIEF[1][x] * (1 - wrong) / rest for x in (0, 1)} for _ in rules]
    broad = [_broken(BELIEF[-1], g, BELIEF[-1][-1], 1 - passed) for g in good]
    kinds = [_broken(KIND, g, KIND[-1], 1) for g in good]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(steps):
        mass = [0.0] * len(share)
        seen = [[dict.fromkeys((-1, 0, 1), 0.0) for _ in rules] for _ in range(3)]
        for v, n in patterns.items():
            # Odds of each class against good at equal shares: a kind differs in its own rule only.
            odds = [1.0, math.prod(broad[k][x] / good[k][x] for k, x in enumerate(v)), *(kinds[k][x] / good[k][x] for k, x in enumerate(v))]
            weight = [p * x for p, x in zip(share, odds, strict=True)]
            whole = sum(weight)
            post[v] = weight[0] / whole
            part = [n * x / whole for x in weight]
            mass = [a + x for a, x in zip(mass, part, strict=True)]
            for k, x in enumerate(v):
                seen[0][k][x] += max(0.0, n - part[1] - part[2 + k])
                seen[1][k][x] += part[1]
                seen[2][k][x] += part[2 + k]
        good = [_right(_smooth(c, BELIEF[1], extra), wrong) for c in seen[0]]
        broad = [_broken(_smooth(c, BELIEF[-1], extra), g, BELIEF[-1][-1], 1 - passed) for c, g in zip(seen[1], good, strict=True)]
        kinds = [_broken(_smooth(c, KIND, extra), g, KIND[-1], 1) for c, g in zip(seen[2], good, strict=True)]
        new = [(m + extra * b) / (total + extra) for m, b in zip(mass, start, strict=True)]
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-9
        share = new
        if done:
            break
    return post


def _judged(rows: DataFrame) -> DataFrame:
    """rows (with v) and quality, the posterior of their votes."""
    # One row per vote pattern comes to the driver: 3 ** len(rules) at most.
    posterior = fitted({tuple(r.v): r.n for r in rows.groupBy("v").agg(F.count("*").alias("n")).collect()})
    known = rows.sparkSession.createDataFrame([(list(v), p) for v, p in posterior.items()], "v array<int>, quality double")
    return rows.join(F.broadcast(known), "v")


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Per document: id, the measures, base_failed, quality (posterior of being good) and kept.

    base_failed: under 20 words, or over 30 of 100 words in repeated windows; such documents
    are never kept. Others are kept if quality is at least least. Every row is judged on its
    own text (null: empty), whatever its id; an empty table gives an empty one; other columns
    are not read.
    """
    out = _judged(scratch.cut(votes(measures(docs, id_col, text_col), rules), "votes"))
    out = out.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns.

    Rows are written once with their votes and read again with the verdict, so no text is
    shuffled; null and repeated ids make no difference.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col), F.col(text_col))
    rows = votes(measures(whole, id_col, text_col, ("_row",)), rules).select("_row", "v", _failed().alias("failed"))
    return _judged(scratch.cut(rows, "voted")).filter(~F.col("failed") & (F.col("quality") >= least)).select("_row.*")
