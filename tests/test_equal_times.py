"""Queries over events that share a time: such rows follow their values."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from sparkgrid.operators.ordered import POS, with_position
from tests.compare import compare

START = dt.datetime(2024, 1, 1)
FILLS = ["fill_by_series", "fill_null_series"]
ORDERED = ["positions", "lags_by_series", "lags_null_series", "rolling_by_series", "sequences_by_series", "time_split_null_series"]


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Two series of 700 events at 90 different times, some of them equal in all columns."""
    folder, rng = tmp_path_factory.mktemp("equal-times"), np.random.default_rng(5)
    made = pd.DataFrame({
        "event_id": np.arange(1400), "ts": START + pd.to_timedelta(rng.integers(0, 90, 1400), "min"),
        "user_id": 1, "event_type": np.repeat(["view", "click"], 700), "value": rng.integers(0, 200, 1400) / 2.0})
    made["ts"] = made["ts"].astype("datetime64[us]")
    connection = duckdb.connect()
    connection.register("made", made)
    connection.execute(f"copy (select * from made) to '{folder}/events.parquet' (format parquet)")
    connection.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", FILLS + ORDERED)
def test_rows_of_one_time_follow_their_values(spark, events, name):
    folder, connection = events
    sql = oracle_sql()[name]
    if name in FILLS:  # the windows that follow have the positions to go by
        sql = sql.replace("order by ts", 'order by ts, "value"', 1).replace("order by ts ", "order by pos ")
    else:
        sql = sql.replace("order by ts", 'order by ts, "value"')
    assert compare(queries()[name](spark, folder), connection, sql) is None


def test_equal_rows_have_different_positions(spark):
    df = spark.createDataFrame([(None, START, 1.0)] * 50 + [("a", START, None), ("a", START, 2.0)],
                               "s string, ts timestamp_ntz, v double")
    rows = with_position(df, keys=["s"], ties=["v"]).df.collect()
    assert sorted(r[POS] for r in rows if r.s is None) == list(range(50))
    assert [(r.v, r[POS]) for r in sorted((r for r in rows if r.s), key=lambda r: r[POS])] == [(None, 0), (2.0, 1)]
