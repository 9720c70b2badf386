"""Exact quantiles (linear interpolation) without one task seeing all values.

``percentile`` keeps every distinct value of a group in one task, so it serves
groups of a checked size only. Larger groups are cut into equal-width bins,
whose counts tell which bins hold the wanted ranks; only the values of these
bins are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.session import join_small, stage

BINS = 4_096
# Largest group (in rows) that is left to the built-in aggregate.
AGGREGATE_ROWS = 100_000
# Largest bin (in rows) that is ranked by one window task; larger ones are range-partitioned.
WINDOW_ROWS = 1_000_000

NAME, VALUE = "name", "value"
# Names of result and helper columns.
RESERVED = {NAME, VALUE, "n", "p", "k", "v", "q", "c", "lo", "hi", "bin", "first", "start", "least", "most"}


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, list[float]]], keys: Iterable[str] = (),
                    aggregate_rows: int = AGGREGATE_ROWS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Quantiles of several expressions at once, per series.

    ``wanted`` maps a name to (expression, probabilities); NULL values are left
    out. Returns (keys…, name, p, n, q) with n = number of values; a name
    without values has no rows.
    """
    keys = list(keys)
    if clash := RESERVED & {*keys}:
        raise ValueError(f"series keys may not be named {sorted(clash)}")
    group = [*keys, NAME]
    # Adding zero makes -0.0 a plain zero, so that both ways return the same.
    entries = F.array(*[F.struct(F.lit(n).alias(NAME), (e.cast("double") + 0.0).alias(VALUE))
                        for n, (e, _) in wanted.items()])
    values = df.select(*keys, F.inline(entries)).where(F.col(VALUE).isNotNull())
    probabilities = F.map_from_arrays(
        F.array(*[F.lit(n) for n in wanted]),
        F.array(*[F.array(*map(F.lit, ps)) for _, ps in wanted.values()]),
    )

    extent = values.groupBy(*group).agg(F.count("*").alias("n"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"))
    if keys:
        extent = stage(extent, "extent")
        size = extent.agg(F.max("n").alias("largest"), F.count("*").alias("groups")).first()
        largest, groups = size.largest or 0, size.groups
    else:
        # One row per name.
        rows = extent.collect()
        largest, groups = max((r.n for r in rows), default=0), len(rows)
        extent = df.sparkSession.createDataFrame(rows, extent.schema)
    if largest <= aggregate_rows:
        return _by_aggregate(values, group, wanted, probabilities)

    spread = F.col("hi") - F.col("lo")
    bin_no = F.when(spread > 0, F.least(F.floor((F.col(VALUE) - F.col("lo")) / spread * BINS), F.lit(BINS - 1)))
    binned = join_small(values, extent, group, rows=groups).select(
        *group, "n", VALUE, F.coalesce(bin_no, F.lit(0)).alias("bin"))

    # At most BINS rows per group reach the running sum.
    cells = binned.groupBy(*group, "n", "bin").agg(F.count("*").alias("c"), F.min(VALUE).alias("least"),
                                                   F.max(VALUE).alias("most"))
    running = Window.partitionBy(*group).orderBy("bin")
    cells = cells.withColumn("first", F.sum("c").over(running) - F.col("c"))
    # The wanted ranks that fall into a cell: (p, rank) pairs, few per group.
    rank = (F.col("n") - 1) * F.col("p")
    hits = (
        cells.withColumn("p", F.explode(F.element_at(probabilities, F.col(NAME))))
        .withColumn("k", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
        .where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("c")))
    )
    hits = stage(hits, "ranks")
    size = hits.agg(F.max("c").alias("largest"), F.count("*").alias("rows")).first()

    known = hits.where(F.col("least") == F.col("most")).select(*group, "n", "p", "k", F.col("least").alias("v"))
    open_hits = hits.where(F.col("least") < F.col("most"))
    open_bins = open_hits.select(*group, "bin", "first").distinct()
    inside = join_small(binned, open_bins, [*group, "bin"], rows=size.rows)
    distinct_values = inside.groupBy(*group, "bin", "first", VALUE).agg(F.count("*").alias("c"))
    if (size.largest or 0) <= window_rows:
        ranked = _rank_in_window(distinct_values, [*group, "bin"])
    else:
        ranked = _rank_in_ranges(distinct_values, open_hits, [*group, "bin"])
    at_rank = (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("c"))
    found = (
        join_small(ranked.select(*group, "bin", VALUE, "c", "start"),
                   open_hits.select(*group, "bin", "n", "p", "k"), [*group, "bin"], rows=size.rows)
        .where(at_rank)
        .select(*group, "n", "p", "k", F.col(VALUE).alias("v"))
    )
    points = known.unionByName(found)
    low, high = F.min_by("v", "k"), F.max_by("v", "k")
    return points.groupBy(*group, "p", "n").agg(low.alias("_low"), high.alias("_high")).select(
        *group, "p", "n", _between(F.col("_low"), F.col("_high")).alias("q"))


def _by_aggregate(values: DataFrame, group: list[str], wanted: Mapping[str, tuple[Column, list[float]]],
                  probabilities: Column) -> DataFrame:
    every = sorted({p for _, ps in wanted.values() for p in ps})
    found = values.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.arrays_zip(F.array(*map(F.lit, every)).alias("p"),
                     F.percentile(VALUE, F.array(*map(F.lit, every))).alias("q")).alias("_all"))
    rows = found.select(*group, "n", F.inline("_all").alias("p", "q"))
    rows = rows.where(F.array_contains(F.element_at(probabilities, F.col(NAME)), F.col("p")))
    return rows.select(*group, "p", "n", "q")


def _between(low: Column, high: Column) -> Column:
    """Linear interpolation as the built-in ``percentile`` has it, to the last digit and for infinities."""
    rank = (F.col("n") - 1) * F.col("p")
    return F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)


def _rank_in_window(distinct_values: DataFrame, cell: list[str]) -> DataFrame:
    w = Window.partitionBy(*cell).orderBy(VALUE)
    return distinct_values.withColumn("start", F.col("first") + F.sum("c").over(w) - F.col("c"))


def _rank_in_ranges(distinct_values: DataFrame, open_hits: DataFrame, cell: list[str]) -> DataFrame:
    """Rank a large cell: order by range partition, and rank only the partitions that hold a wanted rank."""
    by = [*cell, VALUE]
    ranges = stage(
        distinct_values.repartitionByRange(*by)
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    blocks = ranges.groupBy(*cell, "first", "_part").agg(F.sum("c").alias("_n"))
    w = Window.partitionBy(*cell).orderBy("_part")
    blocks = blocks.withColumn("_start", F.col("first") + F.sum("_n").over(w) - F.col("_n"))
    holds = (F.col("k") >= F.col("_start")) & (F.col("k") < F.col("_start") + F.col("_n"))
    wanted = (
        join_small(blocks, open_hits.select(*cell, "k"), cell)
        .where(holds).select(*cell, "_part", "_start").distinct()
    )
    rows = join_small(ranges, wanted, [*cell, "_part"])
    inside = Window.partitionBy(*cell, "_part").orderBy(VALUE)
    return rows.withColumn("start", F.col("_start") + F.sum("c").over(inside) - F.col("c"))


def median(df: DataFrame, column: str, keys: Iterable[str] = (), name: str = "median") -> DataFrame:
    """(keys…, median); no row for a series without values."""
    keys = list(keys)
    q = exact_quantiles(df, {column: (F.col(column), [0.5])}, keys)
    return q.select(*keys, F.col("q").alias(name))
