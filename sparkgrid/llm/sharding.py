"""Contiguous shards of near-equal bytes, cut from global prefix sums of document sizes.

Narrow rows (id, size, checksum) are range-partitioned by id and written once;
each partition's total gives the sum before it, a running sum within the
partition does the rest, and a document goes to the shard in which the middle
of its bytes falls. Only the totals, one row per partition, pass through a
window of their own. DataFrame functions only.

Defined cases: NULL text has no bytes (its size is the overhead); NULL ids come
first; rows with equal ids are ordered by checksum and split freely between
shards, so a hot id cannot overfill one; a document larger than a share leaves
neighbouring shards empty; repeated rows are documents of their own; only ids
and texts are read, whatever other columns are called; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.llm.common import text_or_empty
from sparkgrid.session import join_small, stage

SHARDS = 40
OVERHEAD = 16


def assign_shards(df: DataFrame, shards: int = SHARDS, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (from 0 in each shard), grown_shard (NULL)."""
    body = text_or_empty(text)
    narrow = df.select(
        F.col(f"`{id_column}`").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "text_crc32", "size", "tie"]
    written = stage(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
            "part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).drop("tie"), "sizes")

    totals = stage(written.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    whole = totals.agg(F.count("*").alias("parts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()

    within = Window.partitionBy("part").orderBy("row")
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(
        within.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    placed = stage(join_small(written, offsets, ["part"], rows=whole.parts).select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("position"),
        F.least(F.lit(shards - 1), F.floor(
            middle.cast("decimal(38,0)") * shards / (2 * max(whole.bytes, 1)))).cast("int").alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return join_small(placed, first, ["shard"], rows=shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
