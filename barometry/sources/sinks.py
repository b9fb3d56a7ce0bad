"""Writers of features, exports, sweeps and alerts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.envelope import sweep


def replace_features(rows: DataFrame, path: str) -> None:
    """Replace the features of every (symbol, session key) that rows has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "session_key").parquet(path)


def export(rows: DataFrame, path: str, kind: str = "csv", symbols: list[str] | None = None, order: Sequence[str] = ()) -> None:
    """rows (of the symbols asked for) as CSV with a header, or as Parquet; in order within and across files, if one is named."""
    some = rows if symbols is None else rows.filter(F.col("symbol").isin(symbols))
    some = some.orderBy(*order) if order else some
    writer = some.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def export_matches(rows: DataFrame, hits: DataFrame, path: str, kind: str = "csv") -> None:
    """The feature rows of a question's matches, with outcome_success and outcome_value."""
    found = hits.select("session_id", F.col("success").alias("outcome_success"), F.col("value").alias("outcome_value"))
    export(rows.join(found, "session_id"), path, kind, order=("symbol", "session_key", "trade_date"))


def sweep_artefacts(rows: DataFrame, presets, path: str) -> None:
    """Results of all questions, the features they were asked of and what each covers; never bars."""
    sweep(rows, presets).write.mode("overwrite").json(f"{path}/results")
    rows.write.mode("overwrite").parquet(f"{path}/features")
    rows.groupBy("symbol", "session_key").agg(F.count("*").alias("sessions"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day")).write.mode("overwrite").json(f"{path}/manifest")


def replace_tags(tags: DataFrame, path: str) -> None:
    """Write (date, event) rows, replacing the events that tags has."""
    tags.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event").parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)
