"""Stored answers: each question's hits by series and year, from which any span is summed without asking the rows again.

A tally row has a year's n and k of one question and series, and its days (date, success) in
order, 366 at most, and a sketch of its values. An answer up to a date takes whole years as they are and cuts the days of
one; so do the half-against-half split and the recent sessions. When a series changes, its
partition alone is made anew.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import RECENT, wilson
from .catalog import Preset
from .envelope import KEYS, QUANTILES, SERIES, guarded, matching

_DAYS = "array<struct<date:date,success:boolean>>"
SCHEMA = f"qid string, year int, n long, k long, days {_DAYS}, sketch binary, symbol string, session_key string"
#: The sketches' parameter: the rank of a quantile is off by about 1.65 / ACCURACY of the values at most, in 99 of 100 cases.
ACCURACY = 400


def tally(rows: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """rows: features with what the questions name; the tallies of all questions from one scan and one aggregation."""
    hits = matching(rows, presets).withColumn("year", F.year("trade_date"))
    days = F.sort_array(F.collect_list(F.struct(F.col("trade_date").alias("date"), "success")))
    return hits.groupBy("qid", *SERIES, "year").agg(F.count("*").alias("n"), F.sum(F.col("success").cast("long")).alias("k"), days.alias("days"), F.kll_sketch_agg_double("value", ACCURACY).alias("sketch")).select("qid", "year", "n", "k", "days", "sketch", *SERIES)


def marks(rows: DataFrame) -> DataFrame:
    """What tells that a series' rows have changed: their number, last date, and a sum over hashes of all columns."""
    digest = F.xxhash64(*(F.col(c).cast("string") for c in sorted(rows.columns))).cast("decimal(38,0)")
    return rows.groupBy(*SERIES).agg(F.count("*").alias("rows"), F.max("trade_date").alias("last"), F.sum(digest).alias("digest"))


def refresh(rows: DataFrame, presets: Sequence[Preset], path: str) -> DataFrame:
    """Bring the store at path up to rows and return the series that were made anew.

    Series are compared by their marks; only the changed ones are asked, and only their
    partitions (symbol, session_key) are replaced. A store is of one list of questions.
    """
    spark = rows.sparkSession
    now = marks(rows)
    old = stored(spark, f"{path}/marks", now.schema)
    changed = now.join(old.withColumnsRenamed({"rows": "o_rows", "last": "o_last", "digest": "o_digest"}), SERIES, "left").filter(F.col("o_rows").isNull() | (F.col("rows") != F.col("o_rows")) | (F.col("last") != F.col("o_last")) | (F.col("digest") != F.col("o_digest"))).select(now.columns)
    where = f"{path}/changed"
    changed.write.mode("overwrite").parquet(where)
    changed = spark.read.schema(now.schema).parquet(where)
    write = lambda frame, name: frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES).parquet(f"{path}/{name}")
    # Marks come last: a refresh that fails before is done again.
    write(tally(rows.join(changed.select(*SERIES), SERIES, "left_semi"), presets), "tallies")
    write(changed, "marks")
    return changed.select(*SERIES)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows at path, or none where nothing has been written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's tallies; a filter on symbol or session_key reads only their partitions."""
    return stored(spark, f"{path}/tallies", SCHEMA)


def answered(tallies: DataFrame, before: DataFrame | None = None, last: int = RECENT, **guards) -> DataFrame:
    """n, k, estimate, interval, guards, halves (n1, k1, n2, k2, agree) and recency (n_recent, k_recent, diverges) per question and series.

    before: symbol, session_key, today; only sessions before that date count (null: all). Rows
    of a series are one a year, so the windows here hold a few dozen rows.
    """
    if before is None:
        rows = tallies.withColumn("today", F.lit(None).cast("date"))
    else:
        rows = tallies.join(before.select(*SERIES, "today"), SERIES)
    rows = rows.filter(F.col("today").isNull() | (F.col("year") <= F.year("today")))
    cut = F.col("year") == F.year("today")
    rows = rows.withColumn("days", F.when(cut, F.filter("days", lambda d: d["date"] < F.col("today"))).otherwise(F.col("days")))
    rows = rows.withColumns({"n": F.when(cut, F.size("days").cast("long")).otherwise(F.col("n")), "k": F.when(cut, _successes("days")).otherwise(F.col("k"))})
    own = Window.partitionBy(*KEYS)
    rows = rows.withColumns({"total": F.sum("n").over(own), "earlier": F.sum("n").over(own.orderBy("year")) - F.col("n")})
    within = lambda x: F.least(F.greatest(x - F.col("earlier"), F.lit(0)), F.col("n"))
    rows = rows.withColumns({"m1": within(F.floor(F.col("total") / 2)), "m_old": within(F.greatest(F.col("total") - last, F.lit(0)))})
    first = lambda m: F.when(F.col(m) == F.col("n"), F.col("k")).when(F.col(m) == 0, F.lit(0)).otherwise(_successes(f"slice(days, 1, cast({m} as int))"))
    rows = rows.withColumns({"s1": first("m1"), "s_old": first("m_old")})
    sums = {"n": "n", "k": "k", "n1": "m1", "k1": "s1", "n2": "n - m1", "k2": "k - s1", "n_recent": "n - m_old", "k_recent": "k - s_old"}
    out = rows.groupBy(*KEYS).agg(*(F.sum(F.expr(e)).alias(name) for name, e in sums.items())).filter("n > 0")
    bounds = {p: wilson(F.col(f"n{p}"), F.col(f"k{p}")) for p in ("", "1", "2", "_recent")}
    overlap = lambda a, b: (bounds[a][0] <= bounds[b][1]) & (bounds[b][0] <= bounds[a][1])
    found = {"agree": F.when((F.col("n1") > 0) & (F.col("n2") > 0), overlap("1", "2")), "diverges": F.when(F.col("n") > last, ~overlap("", "_recent"))}
    return guarded(out.withColumns(found), **guards)


def _successes(days: str) -> Column:
    return F.expr(f"cast(size(filter({days}, d -> d.success)) as long)")


def by_year(tallies: DataFrame) -> DataFrame:
    """n, k and estimate per question, series and year, as envelope.per_year() gives them."""
    return guarded(tallies.select(*KEYS, "year", "n", "k"), force=True).drop("low_sample", "refused")


def quantiles(tallies: DataFrame) -> DataFrame:
    """count and near quantiles of the values of all eligible sessions, from merged sketches: no value is read again, and years and series add up.

    The exact ones are envelope.distribution()'s; these are for spans too long to sort.
    """
    out = tallies.groupBy(*KEYS).agg(F.kll_merge_agg_double("sketch", ACCURACY).alias("sketch"))
    n = F.kll_sketch_get_n_double("sketch")
    at = lambda q: F.when(n > 0, F.kll_sketch_get_quantile_double(F.when(n > 0, F.col("sketch")), F.lit(q)))
    return out.select(*KEYS, n.alias("count"), *(at(q).alias(name) for name, q in QUANTILES.items()))
