"""One batch brings a whole series: features go on in parts, and what waits is held as packed numbers."""

import datetime as dt

import numpy as np

from sparkgrid.streaming import features
from sparkgrid.streaming.live import run_to_table


def test_a_long_batch_goes_out_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "PART", 100)
    folder, rng = str(tmp_path / "arriving"), np.random.default_rng(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=int(k)), None if v < 3 else float(v))
            for k, v in zip(rng.integers(0, 900, 2000), rng.integers(0, 60, 2000))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    made = features.stream_features(stream, "value", {"lag_1": 1, "lag_24": 24}, {24: ("mean", "std")}, "1 hour")
    out = run_to_table(made).collect()

    # By time and value, missing ones last; those of the last hour wait.
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0.0))
    last = ordered[-1][0] - dt.timedelta(hours=1)
    expected = []
    for k, (ts, value) in enumerate(ordered):
        if ts <= last:
            past = np.array([np.nan if v is None else v for _, v in ordered[max(0, k - 24):k]])
            found = features.window_features(past, {"lag_1": 1, "lag_24": 24}, {24: ("mean", "std")})
            expected.append((ts, value, *found.values()))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))


def test_state_is_packed():
    assert all(f.split()[1] == "binary" for f in features.STATE.split(", "))
