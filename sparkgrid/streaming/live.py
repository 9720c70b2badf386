"""Classification of hours as they arrive.

The level of a row depends on the row and six numbers only, so the batch
expression runs unchanged on a stream and needs no state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from sparkgrid.operators.levels import classify
from sparkgrid.session import staging_path


def classify_stream(stream: DataFrame, thresholds: Mapping[str, float], gap: str = "pred_gap") -> DataFrame:
    return classify(stream, gap, thresholds)


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived, append it to a table, and return the table.

    A restart with the same ``path`` and ``checkpoint`` takes up where it stopped.
    """
    spark = stream.sparkSession
    path = path or staging_path(spark, "live")
    checkpoint = checkpoint or staging_path(spark, "live-progress")
    job = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
