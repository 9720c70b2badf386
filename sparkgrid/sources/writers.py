"""Writing of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", ts: str = "ts", by_year: bool = True,
                mode: str = "overwrite") -> None:
    """Write a result table; parquet is split into one folder per year.

    Rows are range-partitioned by time first: a task then writes few folders,
    and a year with very many rows is written by many tasks.
    """
    if fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
        return
    if by_year:
        if "year" not in df.columns:
            df = df.withColumn("year", F.year(ts))
        df.repartitionByRange(ts).write.mode(mode).partitionBy("year").format(fmt).save(path)
        return
    df.write.mode(mode).format(fmt).save(path)
