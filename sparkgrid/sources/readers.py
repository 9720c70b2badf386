"""Reading of raw and intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrid.constants import CLEANING_COLUMNS, RAW_TIME, TEXT_COLUMNS
from sparkgrid.functions.columns import nan_to_null
from sparkgrid.session import join_keys


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of the header line; reads no data rows."""
    return spark.read.option("header", True).csv(path).columns


def read_raw(spark: SparkSession, path: str, columns: Iterable[str], ts: str = RAW_TIME,
             fmt: str = "csv") -> DataFrame:
    """The time column and the listed measurements of a wide raw table.

    CSV needs no type inference: everything but the time is a double, and the
    parser materialises the listed columns only. Rows with an unreadable time
    are kept with a NULL time.
    """
    columns = list(columns)
    if fmt == "csv":
        wanted = {ts, *columns}
        schema = T.StructType([
            T.StructField(c, T.DoubleType() if c in wanted and c != ts else T.StringType())
            for c in csv_columns(spark, path)
        ])
        missing = wanted - set(schema.names)
        if missing:
            raise ValueError(f"columns not in {path}: {sorted(missing)}")
        rows = spark.read.schema(schema).option("header", True).csv(path)
    else:
        rows = spark.read.format(fmt).load(path)
    return nan_to_null(parse_time(rows.select(ts, *columns), ts))


def read_checked(spark: SparkSession, path: str, columns: Iterable[str], ts: str = RAW_TIME) -> tuple[DataFrame, DataFrame]:
    """The readable rows of a wide raw CSV, as ``read_raw`` has them, and the others as (file, line, reason).

    ``reason`` is "columns" where a line has too few or too many of them,
    "value" where a listed measurement is no number, else "time". Every line of
    the files is in one of the two tables.
    """
    columns = list(columns)
    names = csv_columns(spark, path)
    missing = {ts, *columns} - set(names)
    if missing:
        raise ValueError(f"columns not in {path}: {sorted(missing)}")
    # As text, so that a line is whole whatever its values are.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]])
    # Lines are counted by all their columns, in both tables.
    rows = spark.read.schema(schema).option("header", True).option("columnPruning", False).csv(path)
    numbers = {c: F.col(c).try_cast("double") for c in columns}
    bad_value = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & numbers[c].isNull() for c in columns])
    bad_time = F.try_to_timestamp(ts).isNull()
    reason = F.when(F.col("_corrupt_record").isNotNull(), "columns").when(bad_value, "value").when(bad_time, "time")
    marked = rows.withColumn("_reason", reason)
    good = marked.where(F.col("_reason").isNull()).select(
        F.try_to_timestamp(ts).alias(ts), *[numbers[c].alias(c) for c in columns])
    line = F.coalesce("_corrupt_record", F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in names]))
    rejected = marked.where(F.col("_reason").isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), line.alias("line"), F.col("_reason").alias("reason"))
    return nan_to_null(good), rejected


def parse_time(df: DataFrame, ts: str = RAW_TIME) -> DataFrame:
    """Time text as a UTC timestamp; text that is no time becomes NULL."""
    if isinstance(df.schema[ts].dataType, T.StringType):
        return df.withColumn(ts, F.try_to_timestamp(ts))
    return df


def rename(df: DataFrame, mapping: Mapping[str, str], ts: str = RAW_TIME) -> DataFrame:
    """Short column names; the time column becomes ``ts``."""
    return df.withColumnsRenamed({ts: "ts", **mapping})


def read_short(spark: SparkSession, path: str, mapping: Mapping[str, str] = CLEANING_COLUMNS,
               fmt: str = "csv") -> DataFrame:
    """``read_raw`` for the columns of a mapping, already renamed."""
    return rename(read_raw(spark, path, mapping, fmt=fmt), mapping)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
               ts: str = "ts", text: Iterable[str] = ()) -> DataFrame:
    """An intermediate table; CSV takes its schema.

    Without one the time is a timestamp, the columns that hold text in the
    package's own tables (``TEXT_COLUMNS``) and those in ``text`` stay text, and
    all others are numbers.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if schema is None:
        words = {*TEXT_COLUMNS, *text}
        schema = T.StructType([
            T.StructField(c, T.TimestampType() if c == ts else T.StringType() if c in words else T.DoubleType())
            for c in csv_columns(spark, path)])
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def try_read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table, or None if there is none at ``path``."""
    try:
        return read_table(spark, path, fmt, **options)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def choose_source(preferred: DataFrame | None, fallback: DataFrame | None) -> DataFrame | None:
    """The table with more rows, ``preferred`` among equals; None if there is neither."""
    if preferred is None or fallback is None:
        return preferred if fallback is None else fallback
    return preferred if preferred.count() >= fallback.count() else fallback


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The listed columns that the table has, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def demand_source(actuals: DataFrame, predictions: DataFrame | None, models: Iterable[str] = ("pred_gbt",),
                  ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, ts, actual_demand, pred_demand) of the rows of ``actuals``.

    Takes the first of ``models`` that the predictions have, else their actual
    load; without predictions the actual load of ``actuals`` stands in.
    """
    keys = list(keys)
    if predictions is None:
        return actuals.select(*keys, ts, F.col("load_actual").alias("actual_demand"),
                              F.col("load_actual").alias("pred_demand"))
    column = next((m for m in models if m in predictions.columns), "load_actual")
    known = predictions.select(*keys, ts, F.col("load_actual").alias("actual_demand"),
                               F.col(column).alias("pred_demand"))
    return join_keys(known, actuals.select(*keys, ts), [*keys, ts], known=[ts])
