"""Features of a stream against those of the batch, over disorder, restarts and late rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid.operators.ordered import buckets
from sparkgrid.session import stage
from sparkgrid.streaming.features import stream_features, window_features
from sparkgrid.streaming.live import run_to_table
from tests.helpers import frame, hours

LAGS = {"lag_1": 1, "lag_168": 168}
WINDOWS = {6: ("mean_6", None), 168: ("mean_168", "std_168")}
NAMES = ["lag_1", "lag_168", "mean_6", "mean_168", "std_168"]
N = 700


def batch(df, keys):
    b = buckets(df, 168, "ts", keys).lags("value", LAGS)
    for rows, (mean, std) in WINDOWS.items():
        b = b.rolling("value", rows, mean, std)
    return b.close()


def files(spark, tmp_path, disorder):
    """Two series (one without a name) in seven files; within a file and between neighbours hours are in disorder."""
    rng = np.random.default_rng(3)
    parts = []
    for name in ("a", None):
        pdf = hours(N, value=np.where(rng.random(N) < 0.03, np.nan, rng.normal(0, 100, N).round(3)))
        pdf["series_id"], pdf["file"] = name, np.clip((np.arange(N) + rng.integers(-disorder, disorder + 1, N)) // 100, 0, 6)
        parts.append(frame(spark, pdf))
    rows = stage(parts[0].unionByName(parts[1]))
    folder = str(tmp_path / "arriving")
    for k in range(7):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return rows.drop("file"), folder


def read(spark, folder):
    return spark.readStream.schema("ts timestamp_ntz, value double, series_id string").option(
        "maxFilesPerTrigger", 1).parquet(folder)


def table_of(df):
    return {(r.series_id, r.ts): tuple(r[n] for n in ["value", *NAMES]) for r in df.collect()}


def alike(found, expected):
    for key, values in found.items():
        for a, b in zip(values, expected[key]):
            assert (a is None) == (b is None)
            assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-7)


def test_stream_equals_batch(spark, tmp_path):
    rows, folder = files(spark, tmp_path, 20)
    made = stream_features(read(spark, folder), "value", LAGS, WINDOWS, "48 hours", keys=["series_id"])
    out = run_to_table(made)
    found = table_of(out)
    # Each hour once, but for those that the watermark has not passed.
    assert out.count() == len(found) == 2 * (N - 48)
    alike(found, table_of(batch(rows, ["series_id"])))


def test_restart_takes_up_the_state(spark, tmp_path):
    rows, folder = files(spark, tmp_path, 20)
    later = str(tmp_path / "later")
    names = sorted(spark.read.parquet(folder).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    arrived = str(tmp_path / "arrived")
    schema = "ts timestamp_ntz, value double, series_id string"
    for part in (names[:3], names[3:]):
        # Files arrive in the order of their hours, in two runs of the query.
        for name in sorted(part, key=lambda n: spark.read.schema(schema).parquet(n).agg(F.min("ts")).first()[0]):
            spark.read.schema(schema).parquet(name).coalesce(1).write.mode("append").parquet(arrived)
        made = stream_features(read(spark, arrived), "value", LAGS, WINDOWS, "1000 hours",
                               keys=["series_id"])
        out = run_to_table(made, later, str(tmp_path / "progress"))
    assert out.count() == 0  # nothing has left a window of a thousand hours
    last = rows.agg(F.max("ts")).first()[0]
    spark.range(1).select((F.lit(last) + F.expr("interval 2000 hours")).cast("timestamp_ntz").alias("ts"),
                          F.lit(1.0).alias("value"), F.lit("new").alias("series_id")).write.mode("append").parquet(arrived)
    made = stream_features(read(spark, arrived), "value", LAGS, WINDOWS, "1000 hours", keys=["series_id"])
    found = table_of(run_to_table(made, later, str(tmp_path / "progress")))
    assert len(found) == 2 * N
    alike(found, table_of(batch(rows, ["series_id"])))


def test_late_hours_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "arriving")
    pdf = hours(300, value=np.arange(300.0))
    pdf["series_id"] = "a"
    first = frame(spark, pdf.drop(index=50))
    first.coalesce(1).write.parquet(folder)
    late = frame(spark, pdf.loc[[50]])
    progress, out = str(tmp_path / "progress"), str(tmp_path / "out")
    for more in (None, late):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(folder)
        made = stream_features(read(spark, folder), "value", LAGS, WINDOWS, "10 hours", keys=["series_id"])
        found = table_of(run_to_table(made, out, progress))
    assert len(found) == 289 and all(v[0] != 50.0 for v in found.values())
    alike(found, table_of(batch(first, ["series_id"])))


def test_one_series_without_keys(spark, tmp_path):
    folder = str(tmp_path / "arriving")
    pdf = hours(200, value=np.arange(200.0) ** 1.5)
    rows = frame(spark, pdf)
    rows.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp_ntz, value double").parquet(folder)
    found = {r.ts: r.mean_6 for r in run_to_table(stream_features(stream, "value", {}, {6: ("mean_6", None)}, "1 hour")).collect()}
    assert len(found) == 199
    means = {r.ts: r.mean_6 for r in buckets(rows, 6, "ts").rolling("value", 6, "mean_6").close().collect()}
    assert all(found[t] == pytest.approx(means[t]) if means[t] is not None else found[t] is None for t in found)


def test_windows_of_one_row():
    past = np.array([1.0, np.nan, 3.0, 5.0])
    assert window_features(past, {"a": 1, "b": 3, "c": 5}, {2: ("m", "s"), 3: ("w", None)}) == {
        "a": 5.0, "b": None, "c": None, "m": 4.0, "s": pytest.approx(2 ** 0.5), "w": None}
