"""Energy-shaped tables derived from the star schema and the event stream.

Quantities are whole numbers (hundredths of the source values) held as doubles,
so that sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.functions.calendar import start_of_hour
from sparkgrid.operators.rollups import add_empty_bins


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def _sum_if(test: Column, amount: Column) -> Column:
    return F.sum(F.when(test, amount))


def grid_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """One row per hour of the events, with gaps where an hour lacks an event type."""
    kind, c = F.col("event_type"), F.col("c")
    hourly = (
        table(spark, folder, "events").where(F.col("ts").isNotNull())
        .select(start_of_hour("ts").alias("ts"), "event_type", cents("value").alias("c"))
        .groupBy("ts")
        .agg(
            F.sum(F.when(kind == "view", c * 3).when(kind == "purchase", c)).alias("load_c"),
            _sum_if(kind == "view", c * 4).alias("forecast_c"),
            _sum_if(kind == "click", c).alias("solar_c"),
            _sum_if(kind == "error", c).alias("onshore_c"),
            _sum_if(kind == "signup", c).alias("offshore_c"),
            F.max(F.when(kind == "purchase", c)).alias("price_c"),
        )
    )
    every = add_empty_bins(hourly, "ts", F.make_dt_interval(F.lit(0), F.lit(1)))
    wind_c = F.col("onshore_c") + F.col("offshore_c")
    midnight = F.hour("ts") == 0
    return every.select(
        "ts",
        F.col("load_c").cast("double").alias("load_actual"),
        F.col("forecast_c").cast("double").alias("load_forecast"),
        F.col("solar_c").cast("double").alias("solar_gen"),
        wind_c.cast("double").alias("wind_gen"),
        F.col("onshore_c").cast("double").alias("wind_onshore"),
        F.col("offshore_c").cast("double").alias("wind_offshore"),
        F.col("price_c").cast("double").alias("price"),
        F.when(midnight, 100000 + 1000 * F.day("ts")).cast("double").alias("solar_cap"),
        F.when(midnight, 150000 + 1000 * F.day("ts")).cast("double").alias("wind_cap"),
        (F.col("solar_c").cast("double") / 262144).alias("solar_profile"),
        (wind_c.cast("double") / 524288).alias("wind_profile"),
    )


def grid_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Demand from orders and supply from shipped line items, per day over several years."""
    price, total = cents("l_extendedprice"), cents("o_totalprice")
    orders = table(spark, folder, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.sum(total).alias("pred_demand"),
        (_sum_if(F.col("o_orderstatus") != "P", total) * 3 / 2).alias("actual_demand"),
    )
    solar, wind = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    shipped = F.col("l_linestatus") == "F"
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(
        _sum_if(solar, price).alias("pred_solar"),
        _sum_if(wind, price).alias("pred_wind"),
        (_sum_if(solar & shipped, price) * 2).alias("actual_solar"),
        (_sum_if(wind & shipped, price) * 2).alias("actual_wind"),
    )
    joined = orders.join(lines, "ts")
    values = ["pred_demand", "actual_demand", "pred_solar", "pred_wind", "actual_solar", "actual_wind"]
    gap = (F.col("pred_demand") - F.col("pred_solar") - F.col("pred_wind")).cast("double")
    return joined.where(F.col("pred_solar").isNotNull() & F.col("pred_wind").isNotNull()).select(
        "ts", *[F.col(c).cast("double").alias(c) for c in values], gap.alias("pred_gap"))


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a measurement of the series of its type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("series_id"), "ts", cents("value").cast("double").alias("value"))


def regional_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Daily demand per nation: orders joined with customers and nations."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", cents("o_totalprice").alias("c"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    # Orders are summed per customer and day before they meet the dimensions.
    daily = orders.groupBy("o_custkey", "o_orderdate").agg(F.sum("c").alias("c"))
    return (
        daily.join(customers, daily.o_custkey == customers.c_custkey)
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("series_id"), F.col("o_orderdate").alias("ts"))
        .agg(F.sum("c").cast("double").alias("load_actual"))
    )


def demand_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly demand with two stand-in model columns and the operator's forecast."""
    return grid_hourly(spark, folder).where(F.col("load_actual").isNotNull()).select(
        "ts", "load_actual",
        (F.col("load_actual") * 0.75 + 4096).alias("pred_gbt"),
        (F.col("load_actual") * 0.5 + F.col("solar_gen")).alias("pred_rf"),
        F.col("load_forecast").alias("baseline_forecast"),
    )
