"""Exact quantiles of any range of dates, from counts per month and the few bins that hold a wanted rank.

``create`` writes two tables. The counts have one row per series, month and
bin; a bin is a fixed stretch of the logarithm of a value, the same in all
months and series, so counts of months add up. The values lie in a folder per
month, in order of their bin. ``quantiles`` adds up the counts of the whole
months of a range, counts the rows of the (at most two) months that it cuts,
finds the bins of the wanted ranks and reads these bins only; the folder, the
range of time and the bin are filters of the scan. The result is that of all
values of the range, to the last digit, not an estimate.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgrid.session import join_keys, join_small, stage

MONTH = "month_of"
STEPS = 64       # bins between a value and its double


def value_bin(value: Column) -> Column:
    """Rising with the value: steps of the logarithm of its distance from -1 and 1, zero in between."""
    size = F.floor(F.least(F.log2(F.abs(value) + 1) * STEPS, F.lit(2.0 ** 20)))
    return F.when(value < 0, -size).otherwise(size).cast("int")


def create(df: DataFrame, column: str, path: str, ts: str = "ts", keys: Iterable[str] = ()) -> None:
    """Write the values and counts of ``column``; unknown values and times have no part in quantiles."""
    keys = list(keys)
    rows = df.select(*keys, F.col(ts).alias("ts"), F.col(column).cast("double").alias("value")).where(
        "ts is not null and value is not null and not isnan(value)")
    rows = rows.withColumns({"bin": value_bin(F.col("value")), MONTH: F.date_format("ts", "yyyy-MM")})
    # Months may be of any size: ranges of (month, bin) split a large one between tasks.
    rows.repartitionByRange(MONTH, "bin").sortWithinPartitions(MONTH, "bin").write.mode("overwrite").partitionBy(
        MONTH).parquet(f"{path}/values")
    values = df.sparkSession.read.parquet(f"{path}/values")
    values.groupBy(*keys, MONTH, "bin").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def _months(start: datetime, end: datetime) -> tuple[str, str]:
    return start.strftime("%Y-%m"), end.strftime("%Y-%m")


def wanted_bins(spark: SparkSession, path: str, probabilities: list[float], start: datetime, end: datetime,
                keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, p, n, k, bin, first): for each wanted rank ``k`` of ``n`` values its bin and the rank of the bin's first value."""
    keys = list(keys)
    first, last = _months(start, end)
    month = F.col(MONTH)
    cut = ([first] if start != datetime(start.year, start.month, 1) else []) + (
        [last] if end != datetime(end.year, end.month, 1) else [])
    whole = spark.read.parquet(f"{path}/counts").where((month >= first) & (month < last) & ~month.isin(cut)).select(
        *keys, "bin", "n")
    if cut:
        edges = spark.read.parquet(f"{path}/values").where(month.isin(cut) & _inside(start, end))
        whole = whole.unionByName(edges.groupBy(*keys, "bin").agg(F.count("*").alias("n")))
    cells = stage(whole.groupBy(*keys, "bin").agg(F.sum("n").alias("c")), "cells")
    # A few thousand bins per series at most.
    w = Window.partitionBy(*keys).orderBy("bin")
    running = cells.withColumns({"first": F.sum("c").over(w) - F.col("c"), "n": F.sum("c").over(Window.partitionBy(*keys))})
    rank = (F.col("n") - 1) * F.col("p")
    ranks = running.withColumn("p", F.explode(F.array(*map(F.lit, probabilities)))).withColumn(
        "k", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
    held = (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("c"))
    return ranks.where(held).select(*keys, "p", "n", "k", "bin", "first")


def _inside(start: datetime, end: datetime) -> Column:
    return (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))


def wanted_values(spark: SparkSession, path: str, bins: list[int], start: datetime, end: datetime) -> DataFrame:
    """The values of some bins in a range; months and bins are filters of the scan."""
    first, last = _months(start, end)
    return spark.read.parquet(f"{path}/values").where(
        (F.col(MONTH) >= first) & (F.col(MONTH) <= last) & _inside(start, end) & F.col("bin").isin(bins))


def quantiles(spark: SparkSession, path: str, probabilities: list[float], start: datetime, end: datetime,
              keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, p, n, q) over the values from ``start`` up to ``end``, by linear interpolation between ranks.

    A series without values in the range has no rows.
    """
    keys = list(keys)
    hits = stage(wanted_bins(spark, path, probabilities, start, end, keys), "hits")
    # As many bins as ranks are wanted, of all series together at most the bins there are.
    bins = [r.bin for r in hits.select("bin").distinct().collect()]
    values = wanted_values(spark, path, bins, start, end)
    wanted = hits.select(*keys, "bin", "first").distinct()
    inside = join_small(values, wanted, [*keys, "bin"])
    distinct = inside.groupBy(*keys, "bin", "first", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys, "bin").orderBy("value")
    ranked = distinct.withColumn("begin", F.col("first") + F.sum("c").over(w) - F.col("c"))
    found = join_keys(hits.select(*keys, "p", "n", "k", "bin"), ranked.select(*keys, "bin", "value", "begin", "c"),
                      [*keys, "bin"], known=["bin"]).where((F.col("k") >= F.col("begin")) & (F.col("k") < F.col("begin") + F.col("c")))
    ends = found.groupBy(*keys, "p", "n").agg(F.min_by("value", "k").alias("low"), F.max_by("value", "k").alias("high"))
    rank = (F.col("n") - 1) * F.col("p")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        (F.ceil(rank) - rank) * F.col("low") + (rank - F.floor(rank)) * F.col("high"))
    return ends.select(*keys, "p", "n", between.alias("q"))
