"""Summary statistics, distributions and error metrics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrid.constants import HISTOGRAM_BINS
from sparkgrid.functions.columns import share
from sparkgrid.operators.comoments import correlation_pairs  # noqa: F401
from sparkgrid.operators.quantiles import exact_quantiles
from sparkgrid.session import join_keys, join_small, stage

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: list[str] | None = None, decimals: int = 1,
             keys: Iterable[str] = ()) -> DataFrame:
    """Per column: count, mean, std, min, exact quartiles, max, rounded half to even."""
    keys = list(keys)
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    stats = [F.struct(
        F.lit(c).alias("column"),
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
    ) for c in columns]
    moments = df.groupBy(*keys).agg(F.array(*stats).alias("_all")).select(*keys, F.inline("_all"))
    quartiles = (
        exact_quantiles(df, {c: (F.col(c), list(QUARTILES.values())) for c in columns}, keys)
        .groupBy(*keys, F.col("name").alias("column"))
        .agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in QUARTILES.items()])
    )
    both = join_keys(moments, quartiles, [*keys, "column"], "left", known=["column"])
    return both.select(*keys, "column", "count", *[F.bround(c, decimals).alias(c)
                                            for c in ("mean", "std", "min", *QUARTILES, "max")])


def preview(df: DataFrame, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: number of rows and columns, first and last time."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                                 F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def column_types(df: DataFrame) -> DataFrame:
    """(position, column, type, known), one row per column: its type and how many rows have a value, from one pass."""
    columns = [F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"),
                        F.coalesce(F.max(F.typeof(c)), F.lit(kind)).alias("type"), F.count(c).alias("known"))
               for k, (c, kind) in enumerate(df.dtypes)]
    return df.agg(F.array(*columns).alias("_all")).select(F.inline("_all"))


def extremes(df: DataFrame, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: mean, min and max of each column."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggs)


def axis_limits(df: DataFrame, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """Lower and upper limit of a chart that shows all of the columns: min × 0.95 and max × 1.05."""
    low, high = [F.min(c) for c in columns], [F.max(c) for c in columns]
    return df.groupBy(*keys).agg((F.least(*low) if len(low) > 1 else low[0]).alias("low"),
                  (F.greatest(*high) if len(high) > 1 else high[0]).alias("high")
                  ).select(*keys, (F.col("low") * 0.95).alias("low"), (F.col("high") * 1.05).alias("high"))


def kpis(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: mean gap, demand, solar and wind; per cent of rows in deficit and in surplus."""
    return df.groupBy(*keys).agg(
        F.avg("pred_gap").alias("avg_gap"),
        F.avg("pred_demand").alias("avg_demand"),
        F.avg("pred_solar").alias("avg_solar"),
        F.avg("pred_wind").alias("avg_wind"),
        share(F.col("pred_gap") > 0).alias("pct_deficit"),
        share(F.col("pred_gap") <= 0).alias("pct_surplus"),
    )


def gap_shares(df: DataFrame, gap: str, keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: per cent of rows in deficit (> 0) and in surplus (<= 0)."""
    return df.groupBy(*keys).agg(share(F.col(gap) > 0).alias("pct_deficit"), share(F.col(gap) <= 0).alias("pct_surplus"))


def frequency(df: DataFrame, column: str, keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, column, rows, pct) in descending order of rows; equals in order of the value.

    The totals come from the grouped rows, so the data are read once.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(*keys))
    return counted.withColumn("pct", F.col("rows") / total * 100).orderBy(*keys, F.desc("rows"), column)


def correlation(a: Column, b: Column) -> Column:
    """Correlation over rows where both are known; NULL if either is constant there."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Iterable[str] = ()) -> DataFrame:
    """One row per series with one correlation per name."""
    return df.groupBy(*keys).agg(*[correlation(F.col(a), F.col(b)).alias(n) for n, (a, b) in pairs.items()])


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, bin 1…bins, low, high, rows): equal bins from min to max, the last one closed.

    A constant column gets bins over ± 0.5 around its value. Each series has
    its own range; one without known values has no rows.
    """
    return histograms(df, {column: column}, bins, keys).drop("name")


def histograms(df: DataFrame, columns: Mapping[str, str], bins: int = HISTOGRAM_BINS,
               keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, name, bin, low, high, rows): the histograms of several columns, in two passes for all of them."""
    keys = list(keys)
    group = [*keys, "name"]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("_value")) for n, c in columns.items()])
    values = df.select(*keys, F.inline(entries)).where(F.col("_value").isNotNull())
    ends = values.groupBy(*group).agg(F.min("_value").alias("lo"), F.max("_value").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    # One row per series and column, read by both joins.
    ends = stage(ends.select(*group, (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi")), "ends")
    number = F.least(F.width_bucket(F.col("_value"), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    counted = join_small(values, ends, group).groupBy(*group, number.cast("int").alias("bin")).agg(
        F.count("*").alias("rows"))
    width = (F.col("hi") - F.col("lo")) / bins
    every = ends.select(*group, "lo", width.alias("width"),
                        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return join_keys(every, counted, [*group, "bin"], "left", known=["name", "bin"]).select(
        *group, "bin",
        (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("high"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def group_extremes(means: DataFrame, group: str, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row: per name the group with the "most" or "least" of a column; the first group of equals.

    ``wanted`` maps a name to (column, "most" or "least").
    """
    found = []
    for name, (column, which) in wanted.items():
        value = F.col(column) if which == "least" else -F.col(column)
        by = F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(group).alias("g")))
        found.append(F.min_by(F.col(group), by).alias(name))
    return means.agg(*found)


def metrics(df: DataFrame, actual: str, predicted: Mapping[str, str], keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, model, rows, mae, rmse, r2), all models in one pass over rows where both are known.

    R² needs the variance of the actual values on the same rows.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("model"), F.col(actual).cast("double").alias("y"),
                                 F.col(c).cast("double").alias("f")) for n, c in predicted.items()])
    rows = df.select(*keys, F.inline(entries)).where(F.col("y").isNotNull() & F.col("f").isNotNull())
    error = F.col("y") - F.col("f")
    return rows.groupBy(*keys, "model").agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop("y"))).alias("r2"),
    )


def forecast_error(df: DataFrame, error: str = "forecast_error", keys: Iterable[str] = ()) -> DataFrame:
    """One row per series: mean absolute and mean signed error over known rows."""
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(error))).alias("mae"), F.avg(error).alias("mean_error"))


def error_by_hour(df: DataFrame, actual: str, predicted: Mapping[str, str], ts: str = "ts",
                  keys: Iterable[str] = ()) -> DataFrame:
    """Mean absolute error per hour, one column per model."""
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        *[F.avg(F.abs(F.col(actual) - F.col(c))).alias(n) for n, c in predicted.items()])


def model_comparison(df: DataFrame, actual: str, predicted: Mapping[str, str], baseline: str,
                     keys: Iterable[str] = ()) -> DataFrame:
    """Metrics per model, its improvement over the baseline model in per cent, and a verdict.

    ``baseline`` is one of the names in ``predicted``; its own row has no improvement.
    """
    keys = list(keys)
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(Window.partitionBy(*keys))
    compared = metrics(df, actual, predicted, keys).withColumn("_base", base)
    improvement = F.when(F.col("model") != baseline,
                         F.try_divide(F.col("_base") - F.col("mae"), F.col("_base")) * 100)
    return compared.select(
        *keys, "model", "rows", "mae", "rmse", "r2",
        improvement.alias("improvement_pct"),
        F.when(F.col("model") == baseline, "baseline").when(improvement > 0, "better").otherwise("worse")
        .alias("verdict"),
    )


def best_model(comparison: DataFrame, baseline: str) -> DataFrame:
    """The model with the smallest mean absolute error, the baseline left out."""
    return comparison.where(F.col("model") != baseline).orderBy("mae", "model").limit(1)
