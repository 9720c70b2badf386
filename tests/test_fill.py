"""Fills against pandas on long, short, leading and trailing gaps."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkgrid.operators.fill import Fill, fill
from tests.helpers import column, frame, gappy, hours, same

PANDAS = {
    "forward": lambda s, n: s.ffill(limit=n),
    "backward": lambda s, n: s.bfill(limit=n),
    "both": lambda s, n: s.ffill().bfill(),
    "interpolate": lambda s, n: s.interpolate(method="linear", limit=n),
}
RULES = {"a": Fill("forward", 3), "b": Fill("forward"), "c": Fill("both"), "d": Fill("interpolate", 6),
         "e": Fill("backward"), "f": Fill("backward", 2)}


def check(spark, values, bucket_rows):
    pdf = hours(len(values), **{c: values for c in RULES})
    out = fill(frame(spark, pdf), RULES, bucket_rows=bucket_rows)
    for c, rule in RULES.items():
        same(column(out, c), PANDAS[rule.method](pd.Series(values), rule.limit))


@pytest.mark.parametrize("bucket_rows", [7, 64, None])
def test_fills_equal_pandas(spark, bucket_rows):
    values = gappy(600, 0.4)
    values[:9] = values[200:310] = values[-8:] = np.nan
    check(spark, values, bucket_rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 50)), min_size=1, max_size=40), st.integers(1, 9))
def test_fills_equal_pandas_on_any_gaps(spark, values, bucket_rows):
    check(spark, np.array([np.nan if v is None else float(v) for v in values]), bucket_rows)


def test_all_missing_and_empty(spark):
    check(spark, np.full(20, np.nan), 6)
    empty = frame(spark, hours(3, v=np.ones(3))).limit(0)
    assert fill(empty, {"v": Fill("both")}).count() == 0


def test_series_do_not_mix(spark):
    pdf = pd.concat([hours(50, v=gappy(50, 0.6, s)).assign(series=f"s{s}") for s in range(3)])
    out = fill(frame(spark, pdf), {"v": Fill("both")}, keys=["series"], bucket_rows=11)
    for name, part in pdf.groupby("series"):
        same(column(out.where(out.series == name), "v"), part.v.ffill().bfill())


def test_known_values_do_not_change(spark):
    values = gappy(80, 0.3)
    out = fill(frame(spark, hours(80, v=values)), {"v": Fill("interpolate", 2)}, bucket_rows=9)
    filled, known = column(out, "v"), ~np.isnan(values)
    assert (filled[known] == values[known]).all()
