"""States of all pairs against pandas, whatever the split of the rows."""

import numpy as np
import pandas as pd
import pytest

from sparkgrid.operators import comoments
from sparkgrid.operators.comoments import State
from tests.helpers import frame, gappy, hours

COLUMNS = ["a", "b", "c", "flat", "empty"]


def measured(n=900, gaps=0.2):
    rng = np.random.default_rng(2)
    a = gappy(n, gaps, 1) * 1e6                      # far from zero against its spread
    return hours(n, a=a, b=np.where(rng.random(n) < gaps, np.nan, a / 3 + rng.normal(0, 1e9, n)), c=rng.normal(0, 1, n),
                 flat=np.full(n, 0.1), empty=np.full(n, np.nan))


def plain(pdf):
    return {(COLUMNS[j], COLUMNS[i]): pdf[COLUMNS[i]].corr(pdf[COLUMNS[j]]) for i in range(5) for j in range(i + 1, 5)
            if pdf[[COLUMNS[i], COLUMNS[j]]].dropna().shape[0]}


@pytest.mark.parametrize("parts", [1, 7])
def test_pairs_equal_pandas(spark, parts):
    pdf = measured()
    found = {(r["first"], r.second): r.corr for r in comoments.correlation_pairs(
        frame(spark, pdf).repartition(parts), COLUMNS).collect()}
    expected = plain(pdf)
    assert set(found) == set(expected)
    for pair, corr in expected.items():
        assert found[pair] is None if "flat" in pair else found[pair] == pytest.approx(corr, rel=1e-9)


def test_one_row_per_task_and_pair(spark):
    df = frame(spark, measured()).repartition(4)
    assert comoments.co_moments(df, COLUMNS).groupBy("first", "second").count().agg({"count": "max"}).first()[0] <= 4
    plan = comoments.correlation_pairs(df, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_series_and_many_of_them(spark, monkeypatch):
    monkeypatch.setattr(comoments, "HELD_SERIES", 3)
    rng = np.random.default_rng(4)
    pdf = hours(600, a=rng.normal(0, 1, 600), b=gappy(600, 0.3, 3))
    pdf["series_id"] = [None if k % 9 == 0 else f"s{k % 9}" for k in range(600)]
    found = {r.series_id: r.corr for r in comoments.correlation_pairs(frame(spark, pdf), ["a", "b"], ["series_id"]).collect()}
    expected = {k: g.a.corr(g.b) for k, g in pdf.fillna({"series_id": "none"}).groupby("series_id")}
    assert found == pytest.approx({None if k == "none" else k: v for k, v in expected.items()}, rel=1e-9)


def test_states_merge_in_any_order():
    x = measured(300)[COLUMNS].to_numpy(float)
    whole = State.of(x)
    for cut in (1, 17, 150):
        for a, b in ((x[:cut], x[cut:]), (x[cut:], x[:cut])):
            both = State.of(a).merged(State.of(b))
            for name in ("n", "mean", "square", "product"):
                np.testing.assert_allclose(getattr(both, name), getattr(whole, name), rtol=1e-9, atol=1e-6)
    full = x[:, :4][~np.isnan(x[:, :4]).any(axis=1)]
    quick, by_pair = State.of(full), State.of(np.vstack([full, np.full((1, 4), np.nan)]))
    for name in ("n", "mean", "square", "product"):
        np.testing.assert_allclose(getattr(quick, name), getattr(by_pair, name), rtol=1e-9, atol=1e-6)


def test_no_rows(spark):
    df = frame(spark, measured(5))
    assert comoments.correlation_pairs(df.limit(0), COLUMNS).count() == 0
    assert comoments.correlation_pairs(frame(spark, pd.DataFrame({"ts": pd.date_range("2019", periods=2), "a": [np.nan, 1.0],
                                                                  "b": [2.0, np.nan]})), ["a", "b"]).count() == 0
