"""Co-moments of all pairs of columns, pairwise complete: one mergeable state per task and series.

Of the rows where both columns of a pair are known a state holds their number,
both means, both sums of squares about the mean and the sum of products about
the means, for all pairs at once as matrices. Two states merge without loss of
digits (the means' difference enters the sums), within a task batch by batch
and behind the shuffle pair by pair. So a row is read once, makes no further
rows, and a task hands on one row per series and pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.session import ship

HELD_SERIES = 512      # states that a task keeps before it hands them on


@dataclass
class State:
    """Entry (i, j) is over the rows where columns i and j are known: of column i, but for ``product``."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        """The state of rows without a NULL, or pair by pair; values are taken from the first one, so that a constant has no spread."""
        width = x.shape[1]
        known = ~np.isnan(x)
        if len(x) and known.all():
            y = x - x[0]
            mean = y.mean(axis=0)
            product = (y - mean).T @ (y - mean)
            wide = np.ones((width, width))
            return cls(wide * len(x), wide * (mean + x[0])[:, None], wide * np.diag(product)[:, None], product)
        n, mean, square, product = np.zeros((4, width, width))
        for i in range(width):
            for j in range(i, width):
                both = known[:, i] & known[:, j]
                if both.any():
                    a, b = x[both, i], x[both, j]
                    da, db = a - a[0], b - b[0]
                    ma, mb = da.mean(), db.mean()
                    da, db = da - ma, db - mb
                    n[i, j] = n[j, i] = len(a)
                    mean[i, j], mean[j, i] = ma + a[0], mb + b[0]
                    square[i, j], square[j, i] = da @ da, db @ db
                    product[i, j] = product[j, i] = da @ db
        return cls(n, mean, square, product)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        part = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        step = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        both = self.n * part
        return State(n, np.where(self.n > 0, self.mean + step * part, other.mean),
                     self.square + other.square + step * step * both,
                     self.product + other.product + step * step.T * both)


STATE = ("n", "mean_x", "mean_y", "square_x", "square_y", "product")


def co_moments(df: DataFrame, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, first, second, state…) of each pair ``columns[i]``, ``columns[j]``, i < j, as (second, first), per task."""
    ship(df.sparkSession)
    keys = list(keys)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    fields = [T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType([*fields, T.StructField("first", T.StringType()), T.StructField("second", T.StringType()),
                        *[T.StructField(c, T.DoubleType()) for c in STATE]])
    schema = to_arrow_schema(out)
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                     *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def handed_on(states: dict) -> pa.RecordBatch:
        lists = [list() for _ in out]
        for key, s in states.items():
            for i, j in pairs:
                if s.n[i, j] > 0:
                    values = (*key, columns[j], columns[i], s.n[i, j], s.mean[j, i], s.mean[i, j], s.square[j, i],
                              s.square[i, j], s.product[i, j])
                    for held, v in zip(lists, values):
                        held.append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(lists, schema)], schema=schema)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, State] = {}
        for batch in batches:
            x = np.column_stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))])
            groups: dict[tuple, list[int]] = {}
            if keys:
                for at, key in enumerate(zip(*(batch.column(f"k{i}").to_pylist() for i in range(len(keys))))):
                    groups.setdefault(key, []).append(at)
            elif len(x):
                groups[()] = slice(None)
            for key, at in groups.items():
                state = State.of(x[at])
                states[key] = states[key].merged(state) if key in states else state
            if len(states) > HELD_SERIES:
                yield handed_on(states)
                states = {}
        if states:
            yield handed_on(states)

    made = rows.mapInArrow(summed, out)
    return made.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def _merged(a: Column, b: Column) -> Column:
    """The merge of two states of a pair."""
    n = a["n"] + b["n"]
    part = b["n"] / n
    x, y, both = b["mean_x"] - a["mean_x"], b["mean_y"] - a["mean_y"], a["n"] * part
    return F.struct(n.alias("n"), (a["mean_x"] + x * part).alias("mean_x"), (a["mean_y"] + y * part).alias("mean_y"),
                    (a["square_x"] + b["square_x"] + x * x * both).alias("square_x"),
                    (a["square_y"] + b["square_y"] + y * y * both).alias("square_y"),
                    (a["product"] + b["product"] + x * y * both).alias("product"))


def pair_moments(df: DataFrame, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, first, second, n, means, squares, product): the states of all tasks merged, in a fixed order."""
    keys = list(keys)
    states = co_moments(df, columns, keys)
    # One state per task: the list is as long as there are tasks.
    listed = states.groupBy(*keys, "first", "second").agg(F.array_sort(F.collect_list(F.struct(*STATE))).alias("all"))
    whole = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), _merged)
    return listed.select(*keys, "first", "second", whole.alias("s")).select(*keys, "first", "second", "s.*")


def correlation_pairs(df: DataFrame, columns: list[str], keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, first, second, corr); NULL where a column is constant over the rows of its pair."""
    found = pair_moments(df, columns, keys)
    spread = F.sqrt(F.greatest(F.col("square_x"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("square_y"), F.lit(0.0)))
    return found.select(*keys, "first", "second", F.when(spread > 0, F.col("product") / spread).alias("corr"))
