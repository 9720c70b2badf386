"""Reading, writing, fallbacks, streaming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgrid.constants import CLEANING_COLUMNS, FIXED_THRESHOLDS
from sparkgrid.operators.levels import classify
from sparkgrid.sources import readers, writers
from sparkgrid.streaming.live import classify_stream, run_to_table
from tests.helpers import frame, gappy, hours


@pytest.fixture
def raw_csv(tmp_path):
    pdf = pd.DataFrame({"utc_timestamp": ["2019-01-01T00:00:00Z", "2019-01-01T01:00:00Z", "not a time"]})
    for i, name in enumerate(CLEANING_COLUMNS):
        pdf[name] = [i + 0.5, np.nan, i]
    pdf["other"] = ["x", "y", "z"]
    path = tmp_path / "raw.csv"
    pdf.to_csv(path, index=False)
    return str(path)


def test_raw_csv_is_pruned_and_parsed(spark, raw_csv):
    rows = readers.read_short(spark, raw_csv)
    assert rows.columns == ["ts", *CLEANING_COLUMNS.values()]
    assert dict(rows.dtypes)["price"] == "double" and dict(rows.dtypes)["ts"] == "timestamp"
    assert rows.where("ts is null").count() == 1
    assert rows.where("price is null").count() == 1
    plan = readers.read_raw(spark, raw_csv, ["DE_solar_capacity"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<utc_timestamp:string,DE_solar_capacity:double>" in plan
    with pytest.raises(ValueError, match="not in"):
        readers.read_raw(spark, raw_csv, ["nope"])


def test_partitioned_round_trip(spark, tmp_path):
    path, df = str(tmp_path / "t"), frame(spark, hours(200, v=gappy(200, 0.1)))
    writers.write_table(df, path)
    assert (tmp_path / "t" / "year=2018").is_dir() and (tmp_path / "t" / "year=2019").is_dir()
    back = readers.read_table(spark, path)
    assert back.drop("year").exceptAll(df).count() == 0 and back.count() == 200


def test_source_fallbacks(spark, tmp_path):
    small, large = spark.range(2), spark.range(5)
    assert readers.try_read(spark, str(tmp_path / "absent")) is None
    assert readers.choose_source(small, large) is large
    assert readers.choose_source(large, small) is large
    same = spark.range(2)
    assert readers.choose_source(small, same) is small
    assert readers.choose_source(None, small) is small and readers.choose_source(small, None) is small
    assert readers.choose_source(None, None) is None
    assert readers.select_existing(spark.range(1).withColumn("a", F.lit(1)), ["a", "b"]).columns == ["a"]


def test_demand_falls_back_to_actual_load(spark):
    actual = frame(spark, hours(5, load_actual=np.arange(5) * 1.0))
    none = readers.demand_source(actual, None)
    assert none.where("actual_demand = pred_demand").count() == 5
    no_model = readers.demand_source(actual, actual.where("load_actual > 1"))
    assert no_model.where("pred_demand = actual_demand").count() == 3
    model = readers.demand_source(actual, actual.withColumn("pred_gbt", F.lit(7.0)))
    assert model.where("pred_demand = 7").count() == 5


def test_stream_equals_batch(spark, tmp_path):
    rows = frame(spark, hours(300, pred_gap=np.random.default_rng(2).normal(0, 5_000, 300)))
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows.where("pred_gap > 0").write.parquet(folder)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        return run_to_table(classify_stream(stream, FIXED_THRESHOLDS), out, progress)
    assert run().count() == rows.where("pred_gap > 0").count()
    rows.where("pred_gap <= 0").write.mode("append").parquet(folder)
    assert run().exceptAll(classify(rows)).count() == 0
    assert spark.read.parquet(out).count() == 300
