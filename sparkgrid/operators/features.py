"""Ordered model features, splits and sequences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.constants import DEMAND_FEATURES, SEQUENCE_ROWS, SOLAR_FEATURES, TRAIN_SHARE, WIND_FEATURES
from sparkgrid.functions.calendar import calendar, cyclical
from sparkgrid.operators.fill import Fill, fill_ordered
from sparkgrid.operators.ordered import POS, SIZE, Buckets, OrderedRows, buckets, with_position

WEEK_ROWS = 168


def lags(df: DataFrame, column: str, names: dict[str, int], ts: str = "ts", keys: Iterable[str] = (),
         ties: Iterable[str] | None = None) -> DataFrame:
    """Values ``k`` rows earlier, by position."""
    return buckets(df, max(names.values()), ts, keys, ties=ties).lags(column, names).close()


def rolling(df: DataFrame, column: str, windows: dict[int, tuple[str | None, str | None]], ts: str = "ts",
            keys: Iterable[str] = (), ties: Iterable[str] | None = None) -> DataFrame:
    """Mean and deviation of the previous n rows: ``{n: (mean name, std name)}``."""
    b = buckets(df, max(windows), ts, keys, ties=ties)
    for rows, (mean, std) in windows.items():
        b = b.rolling(column, rows, mean, std)
    return b.close()


def demand_features(df: DataFrame, ts: str = "ts", keys: Iterable[str] = (), load: str = "load_actual") -> DataFrame:
    """Rows with a known load and all 19 demand features (complete rows only)."""
    rows = df.where(F.col(load).isNotNull())
    b = (
        buckets(rows, WEEK_ROWS, ts, keys)
        .lags(load, {f"lag_{k}h": k for k in (1, 2, 3, 24, 48, 168)})
        .rolling(load, 6, "roll_6h")
        .rolling(load, 24, "roll_24h", "roll_std_24h")
        .rolling(load, 168, "roll_168h", "roll_std_168h")
    )
    out = cyclical(calendar(b.close(), ts), "hour", "month", "day_of_week")
    return out.dropna("any", subset=[load, *DEMAND_FEATURES])


def supply_features(df: DataFrame, ts: str = "ts", keys: Iterable[str] = (), solar: str = "solar_gen",
                    wind: str = "wind_gen", fill_capacity: bool = True) -> DataFrame:
    """Rows with known load, solar and wind and all solar and wind features (complete rows only).

    Solar and wind features share one pass over the ordered rows; installed
    capacity is carried forward on the same positions, unless it has been
    filled before (``reconstruct`` does).
    """
    rows = df.dropna("any", subset=["load_actual", solar, wind])
    ordered = with_position(rows, ts, keys)
    if fill_capacity:
        filled = fill_ordered(ordered, {"solar_cap": Fill("forward"), "wind_cap": Fill("forward")})
        ordered = OrderedRows(filled, ts, ordered.keys, ordered.rows)
    b = Buckets(ordered, WEEK_ROWS)
    for kind, column, long_means in (("solar", solar, ()), ("wind", wind, (72,))):
        b = b.lags(column, {f"{kind}_lag_{k}h": k for k in (1, 24, 168)})
        for n in (24, *long_means):
            b = b.rolling(column, n, f"{kind}_roll_{n}h")
    out = cyclical(calendar(b.close(), ts), "hour", "month", "day_of_year")
    needed = dict.fromkeys([*SOLAR_FEATURES, *WIND_FEATURES])
    return out.dropna("any", subset=list(needed))


def time_split(df: DataFrame, train_share: float = TRAIN_SHARE, ts: str = "ts", keys: Iterable[str] = (),
               ties: Iterable[str] | None = None) -> DataFrame:
    """Add ``split``: the first ``int(rows × share)`` rows of a series are "train", the rest "test".

    The result reads a written table, so that several fits may use it.
    """
    ordered = with_position(df, ts, keys, ties=ties).df
    train = F.col(POS) < F.floor(F.col(SIZE) * train_share)
    return ordered.withColumn("split", F.when(train, "train").otherwise("test")).drop(POS, SIZE)


def sequences(df: DataFrame, features: list[str], target: str, rows: int = SEQUENCE_ROWS, ts: str = "ts",
              keys: Iterable[str] = (), name: str = "sequence", ties: Iterable[str] | None = None) -> DataFrame:
    """(keys…, ts, sequence, target): the feature rows of the ``rows`` rows before each row.

    A series starts anew per ``keys``; put the split into them to keep train and
    test apart. Rows without a full history are left out.
    """
    step = F.array(*[F.col(c).cast("double") for c in features])
    keys = list(keys)
    b = buckets(df.select(*dict.fromkeys([*keys, ts, *features, target, *(ties or ())])), rows, ts, keys, ties=ties)
    out = b.rows_before(step, rows, name).close()
    return out.where(F.col(name).isNotNull()).select(*keys, ts, name, F.col(target).alias("target"))


def first_rows(df: DataFrame, n: int, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """The first ``n`` rows in time, of each series."""
    keys = list(keys)
    return _top(df, n, F.asc(ts), keys) if keys else df.orderBy(ts).limit(n)


def last_rows(df: DataFrame, n: int, ts: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """The last ``n`` rows in time, of each series; shown in time order."""
    keys = list(keys)
    return (_top(df, n, F.desc(ts), keys) if keys else df.orderBy(F.desc(ts)).limit(n)).orderBy(*keys, ts)


def _top(df: DataFrame, n: int, order: Column, keys: list[str]) -> DataFrame:
    """A rank filter: each task hands on at most ``n`` rows per series."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
