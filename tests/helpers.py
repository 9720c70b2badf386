from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame(spark, pdf: pd.DataFrame):
    """A Spark table of a pandas frame in shuffled row order, NaN as NULL, times without a zone."""
    fields = []
    for name, kind in pdf.dtypes.items():
        if kind.kind == "M":
            fields.append(T.StructField(name, T.TimestampNTZType()))
        elif kind.kind == "f":
            fields.append(T.StructField(name, T.DoubleType()))
        elif kind.kind in "iu":
            fields.append(T.StructField(name, T.LongType()))
        else:
            fields.append(T.StructField(name, T.StringType()))
    shuffled = pdf.sample(frac=1, random_state=7)
    rows = [tuple(None if v is None or v != v else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else
                                                  v.item() if hasattr(v, "item") else v) for v in r)
            for r in shuffled.itertuples(index=False)]
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(3)


def hours(n: int, **columns) -> pd.DataFrame:
    return pd.DataFrame({"ts": pd.date_range("2018-12-28", periods=n, freq="h"), **columns})


def gappy(n: int, share: float, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    values = rng.normal(50_000, 9_000, n)
    values[rng.random(n) < share] = np.nan
    return values


def column(df, name: str, by: str = "ts") -> np.ndarray:
    """Values of a column in order of another, NULL as NaN."""
    rows = df.select(F.col(by).alias("_by"), F.col(name).alias("_v")).collect()
    return np.array([np.nan if r._v is None else r._v for r in sorted(rows, key=lambda r: r._by)], dtype=float)


def same(ours, theirs, tolerance: float = 1e-6):
    theirs = np.asarray(theirs, dtype=float)
    assert len(ours) == len(theirs)
    np.testing.assert_array_equal(np.isnan(ours), np.isnan(theirs))
    np.testing.assert_allclose(ours[~np.isnan(ours)], theirs[~np.isnan(theirs)], atol=tolerance, rtol=1e-9)
