"""A part of the registered queries next to their SQL; ``python -m tests.compare`` runs all of them."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["clean_table", "fill_by_series", "rolling_by_series", "quantile_thresholds", "quantiles_from_ranges",
         "classify_fixed", "classify_override", "correlation_pairs", "histogram", "resample_by_series",
         "year_month_pivot", "override_limits", "sequences", "report_key_insights", "raw_csv", "live_levels"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert compare(queries()[name](spark, FOLDER), connect(FOLDER), oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["level", "rows", "pct"] and rows.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
