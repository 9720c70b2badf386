"""Filling of missing values along a series.

All fills share one plan. Per bucket of consecutive rows the first and last
known value are found; a window over these few summary rows carries them into
the buckets that follow or precede; within a bucket running windows do the rest.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.operators.ordered import BUCKET, POS, SIZE, OrderedRows, with_position

_SERIES = "_series"


@dataclass(frozen=True)
class Fill:
    """How to fill one column. ``limit`` counts consecutive rows; None = no limit.

    ``forward``      repeat the last known value
    ``both``         forward, then the next known value for a leading gap
    ``backward``     repeat the next known value
    ``interpolate``  straight line over the whole gap, forward; a trailing gap
                     repeats the last value; a leading gap stays missing
    """

    method: str = "forward"
    limit: int | None = None


def fill(df: DataFrame, rules: dict[str, Fill], order: str = "ts", keys: Iterable[str] = (),
         bucket_rows: int | None = None, ties: Iterable[str] | None = None) -> DataFrame:
    """Fill each column in ``rules``; other columns and all known values stay as they are."""
    return fill_ordered(with_position(df, order, keys, bucket_rows, ties), rules).drop(POS, SIZE)


def fill_ordered(ordered: OrderedRows, rules: dict[str, Fill]) -> DataFrame:
    """As ``fill`` on rows that already have positions; keeps the positions."""
    columns = ordered.df.columns
    df = ordered.df.withColumn(BUCKET, F.floor(F.col(POS) / ordered.bucket_rows()))
    keys = []
    if ordered.keys:
        # NULLs inside a struct are equal to each other, in joins too.
        df, keys = df.withColumn(_SERIES, F.struct(*ordered.keys)), [_SERIES]
    backward = {c for c, rule in rules.items() if rule.method != "forward"}

    edges = []
    for c in rules:
        known = F.when(F.col(c).isNotNull(), F.col(POS))
        edges += [F.max(known).alias(f"_lp_{c}"), F.max_by(c, known).alias(f"_lv_{c}")]
        if c in backward:
            edges += [F.min(known).alias(f"_fp_{c}"), F.min_by(c, known).alias(f"_fv_{c}")]
    summary = df.groupBy(*keys, BUCKET).agg(*edges)

    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_l{x}_{c}", True).over(earlier).alias(f"_cl{x}_{c}") for c in rules for x in "pv"]
    carried += [F.last(f"_f{x}_{c}", True).over(later).alias(f"_cf{x}_{c}") for c in backward for x in "pv"]
    # Both sides are partitioned by (keys, bucket), which the windows below need anyway.
    df = df.join(summary.select(*keys, BUCKET, *carried), [*keys, BUCKET])

    inside = Window.partitionBy(*keys, BUCKET)
    up_to_here = inside.orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    from_here = inside.orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)

    def nearest(c: str, frame: Window, side: str) -> tuple[Column, Column]:
        known = F.when(F.col(c).isNotNull(), F.col(POS))
        return (F.coalesce(F.last(known, True).over(frame), F.col(f"_c{side}p_{c}")),
                F.coalesce(F.last(c, True).over(frame), F.col(f"_c{side}v_{c}")))

    added = {}
    for c in rules:
        added[f"_pp_{c}"], added[f"_pv_{c}"] = nearest(c, up_to_here, "l")
        if c in backward:
            added[f"_np_{c}"], added[f"_nv_{c}"] = nearest(c, from_here, "f")
    df = df.withColumns(added)
    filled = {c: _filled(c, rule) for c, rule in rules.items()}
    return df.withColumns(filled).select(*columns)


def _filled(c: str, rule: Fill) -> Column:
    value, pos = F.col(c), F.col(POS)
    prev_pos, prev = F.col(f"_pp_{c}"), F.col(f"_pv_{c}")
    if rule.method == "forward":
        return F.coalesce(value, _within(pos - prev_pos, rule.limit, prev))
    next_pos, following = F.col(f"_np_{c}"), F.col(f"_nv_{c}")
    if rule.method == "backward":
        return F.coalesce(value, _within(next_pos - pos, rule.limit, following))
    if rule.method == "both":
        return F.coalesce(value, _within(pos - prev_pos, rule.limit, prev),
                          _within(next_pos - pos, rule.limit, following))
    if rule.method == "interpolate":
        steps = F.nullif(next_pos - prev_pos, F.lit(0))
        line = F.when(next_pos.isNull(), prev).otherwise(prev + (following - prev) * (pos - prev_pos) / steps)
        return F.coalesce(value, _within(pos - prev_pos, rule.limit, line))
    raise ValueError(f"unknown fill method {rule.method!r}")


def _within(distance: Column, limit: int | None, value: Column) -> Column:
    return value if limit is None else F.when(distance <= limit, value)
