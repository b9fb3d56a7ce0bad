"""Registered session queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from barometry import queries

CHECKED = ["resample_bars", "epoch_normalise", "dedupe_clamp", "incremental_append", "half_day_windows", "assign_bars_overnight", "features_wide", "features_wide_ny", "cond_and_or_not", "event_before", "env_stability", "env_recency", "env_distribution", "env_groups", "env_full", "matched_sessions", "context_bars", "session_levels", "outcome_marker", "preset_sweep", "coverage", "freshness", "fingerprint", "trades_dating", "trades_fifo_pnl", "trades_conditioned", "stream_sessions", "exchange_windows_fx", "symbol_windows", "preset_parameters", "preset_sweep_groups", "context_labels", "trades_skips", "provenance", "read_kline_json", "read_calendar_half_days", "read_bars_resynced", "replace_features", "stream_unseen", "stream_developing", "stream_phases", "stream_alerts", "sweep_stored", "features_together", "session_level_facts", "trades_tags"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return None
        return round(float(x), 9) if isinstance(x, float) else str(x)[:10] if hasattr(x, "year") else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
