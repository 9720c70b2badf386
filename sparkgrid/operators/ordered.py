"""Positions, overlapping buckets and carried values for ordered operators.

A window over one long series without a partition key would send every row to
one task. Here the rows are range-partitioned by (keys, time) instead, so that
a single hot series, or a burst in time, is spread over many tasks; each row
gets its dense position within its series; and windows run on buckets of
consecutive positions that carry the few preceding rows they look back to.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.session import join_small, stage

POS = "_pos"          # 0-based position within the series
SIZE = "_size"        # number of rows of the series
BUCKET = "_bucket"
_PART, _ROW, _SAME = "_part", "_row", "_same"

MAX_BUCKET_ROWS = 131_072
MIN_BUCKET_ROWS = 1_024
# Frames up to this many rows are evaluated directly; longer ones from two running halves.
DIRECT_FRAME_ROWS = 32


class OrderedRows:
    """A table with dense positions per series, ready for ordered operators."""

    def __init__(self, df: DataFrame, order: str, keys: list[str], rows: int, bucket_rows: int | None = None):
        self.df, self.order, self.keys, self.rows = df, order, keys, rows
        self._bucket_rows = bucket_rows

    def bucket_rows(self, back: int = 0) -> int:
        """Rows per bucket: enough buckets to use the cluster, each much longer than the overlap."""
        if self._bucket_rows:
            return max(self._bucket_rows, back, 1)
        tasks = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wanted = math.ceil(self.rows / (4 * tasks))
        return max(min(wanted, MAX_BUCKET_ROWS), MIN_BUCKET_ROWS, 8 * back)


def with_position(df: DataFrame, order: str = "ts", keys: Iterable[str] = (), bucket_rows: int | None = None,
                  ties: Iterable[str] | None = None) -> OrderedRows:
    """Number the rows of each series by time: adds ``_pos`` (from 0) and ``_size``.

    The range-partitioned rows are written once to the shared folder. A second
    pass over the plan could draw other range bounds, and a lost executor would
    then renumber rows; reading a written table cannot. Only one count per
    (partition, series) goes through a window of its own.

    Rows without a time have no position and are left out. Rows of a series
    with the same time follow the columns ``ties``, NULL first; rows that are
    equal in these too may change places. Without ``ties`` two rows with the
    same time are an error; they are counted on the sorted rows, which needs no
    further exchange.
    """
    keys = list(keys)
    times = [*keys, order]
    by = times if ties is None else list(dict.fromkeys([*times, *ties]))
    df = df.where(F.col(order).isNotNull())
    row_id = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    staged = stage(
        ranged.withColumns({_PART: F.shiftright(row_id, 33), _ROW: row_id.bitwiseAND(F.lit((1 << 33) - 1))})
        .withColumn(_SAME, F.count("*").over(Window.partitionBy(*times)) if ties is None else F.lit(1)),
        "ordered",
    )
    blocks = staged.groupBy(*keys, _PART).agg(F.count("*").alias("_n"), F.min(_ROW).alias("_first"),
                                                F.max(_SAME).alias("_same"))
    series = Window.partitionBy(*keys)
    before = F.sum("_n").over(series.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(
        *keys, _PART,
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(series).alias(SIZE),
    )
    totals = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                        F.max("_same").alias("same")).first()
    if (totals.same or 0) > 1:
        found = staged.where(F.col(_SAME) > 1).select(*times).first()
        raise ValueError(f"more than one row for {found.asDict()}")
    numbered = join_small(staged, offsets, [*keys, _PART], rows=totals.blocks)
    result = numbered.select(*df.columns, (F.col("_shift") + F.col(_ROW)).alias(POS), SIZE)
    return OrderedRows(result, order, keys, totals.rows, bucket_rows)


class Buckets:
    """Buckets of consecutive rows, each preceded by copies of the last ``back`` rows before it."""

    def __init__(self, ordered: OrderedRows, back: int):
        self.ordered, self.back = ordered, back
        self.columns = ordered.df.columns
        size = ordered.bucket_rows(back)
        self._home = F.floor(F.col(POS) / size)
        overlap = F.when(F.col(POS) % size >= size - back, F.array(self._home, self._home + 1))
        self._within = [*ordered.keys, BUCKET]
        # One exchange for all windows: without it, a window within blocks would partition by block first.
        self.df = ordered.df.withColumn(BUCKET, F.explode(overlap.otherwise(F.array(self._home)))).repartition(
            *self._within)

    def window(self) -> Window:
        return Window.partitionBy(*self._within).orderBy(POS)

    def lags(self, column: str, names: dict[str, int]) -> Buckets:
        """Add ``name`` = value ``k`` rows earlier, for each ``name: k``."""
        assert max(names.values()) <= self.back
        w = self.window()
        self.df = self.df.withColumns({name: F.lag(column, k).over(w) for name, k in names.items()})
        return self

    def rolling(self, column: str, rows: int, mean: str | None = None, std: str | None = None) -> Buckets:
        """Add mean and sample deviation of the ``rows`` values before the row.

        Both are NULL unless all of these values exist.
        """
        assert rows <= self.back
        if rows <= DIRECT_FRAME_ROWS:
            frame = self.window().rowsBetween(-rows, -1)
            full = F.count(column).over(frame) == rows
            stats = {mean: F.avg(column).over(frame), std: F.stddev_samp(column).over(frame)}
        else:
            count, total, squares = self._two_halves(column, rows)
            full = count == rows
            stats = {mean: total / rows, std: F.sqrt(squares / (rows - 1))}
        self.df = self.df.withColumns({n: F.when(full, value) for n, value in stats.items() if n})
        self.df = self.df.drop(*[c for c in self.df.columns if c.startswith("_half_")])
        return self

    def _two_halves(self, column: str, rows: int) -> tuple[Column, Column, Column]:
        """Count, sum and squared deviations of the previous ``rows`` rows at constant cost per row.

        Positions are cut into blocks of ``rows``. Any run of that length is the
        tail of one block plus the head of the next, and both come from running
        aggregates within a block; they merge by the parallel variance formula,
        which subtracts no large sums.
        """
        self.df = self.df.withColumn("_half_block", F.floor(F.col(POS) / rows))
        inside = Window.partitionBy(*self._within, "_half_block")
        running = (Window.unboundedPreceding, Window.currentRow)
        frames = {
            "tail": inside.orderBy(F.desc(POS)).rowsBetween(*running),
            "head": inside.orderBy(POS).rowsBetween(*running),
        }
        for half, frame in frames.items():
            n = F.count(column).over(frame)
            self.df = self.df.withColumn(f"_half_{half}", F.struct(
                n.alias("n"),
                F.sum(column).over(frame).alias("s"),
                (F.var_pop(column).over(frame) * n).alias("q"),
            ))
        # The order of positions, put so that the sort of the head serves it too.
        w = Window.partitionBy(*self._within).orderBy("_half_block", POS)
        # The block ends right before this row when its position is a multiple of the block length:
        # then the head alone is the whole run.
        self.df = self.df.withColumns({
            "_half_head": F.lag("_half_head", 1).over(w),
            "_half_tail": F.when(F.col(POS) % rows != 0, F.lag("_half_tail", rows).over(w)),
        })

        def part(half: str, field: str) -> Column:
            return F.coalesce(F.col(f"_half_{half}.{field}"), F.lit(0))

        n1, n2 = part("head", "n"), part("tail", "n")
        s1, s2 = part("head", "s"), part("tail", "s")
        apart = F.when((n1 > 0) & (n2 > 0), s1 / F.nullif(n1, F.lit(0)) - s2 / F.nullif(n2, F.lit(0))).otherwise(0.0)
        squares = part("head", "q") + part("tail", "q") + apart * apart * n1 * n2 / F.nullif(n1 + n2, F.lit(0))
        return n1 + n2, s1 + s2, squares

    def rows_before(self, value: Column, rows: int, name: str) -> Buckets:
        """Add the array of ``value`` over the ``rows`` rows before; NULL unless there are that many."""
        assert rows <= self.back
        values = F.collect_list(value).over(self.window().rowsBetween(-rows, -1))
        self.df = self.df.withColumn(name, values)
        self.df = self.df.withColumn(name, F.when(F.size(name) == rows, F.col(name)))
        return self

    def close(self) -> DataFrame:
        """Drop the overlapping copies and the helper columns."""
        return self.df.where(F.col(BUCKET) == self._home).drop(BUCKET, POS, SIZE)


def buckets(df: DataFrame, back: int, order: str = "ts", keys: Iterable[str] = (),
            bucket_rows: int | None = None, ties: Iterable[str] | None = None) -> Buckets:
    return Buckets(with_position(df, order, keys, bucket_rows, ties), back)
