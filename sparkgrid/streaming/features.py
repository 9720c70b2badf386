"""Lags and rolling statistics of hours as they arrive, with the last week of each series in Spark's state store.

Hours may come in any order within the watermark's delay. A series keeps the
hours that the watermark has not passed; when it passes one, the hour gets the
features that ``ordered`` computes from the rows before it, by position, and
goes out. So every hour goes out once, in order of time, with what the batch
gives it. An hour that arrives behind the watermark is late: Spark leaves it
out and counts it in the progress of the query; it is in no later window
either. State and position survive a restart with the same checkpoint. State
per series is bounded by ``back`` values and by what arrives within the delay,
at 16 bytes an hour: times and values are kept as packed numbers, and features
are made and handed on ``PART`` rows at a time, since one batch may bring, or
pass, any number of hours of a series.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkgrid.session import ship

STATE = "past binary, times binary, waiting binary"   # float64, int64 (microseconds), float64
PART = 8192


def window_features(past: np.ndarray, lags: Mapping[str, int],
                    windows: Mapping[int, tuple[str | None, str | None]]) -> dict[str, float | None]:
    """Features of the row that follows ``past``, the earlier values of its series; None without a whole window."""
    n, out = len(past), {}
    for name, k in lags.items():
        out[name] = _known(past[n - k]) if n >= k else None
    for rows, (mean, std) in windows.items():
        part = past[n - rows:] if n >= rows else None
        whole = part is not None and not np.isnan(part).any()
        if mean:
            out[mean] = float(part.mean()) if whole else None
        if std:
            out[std] = float(part.std(ddof=1)) if whole else None
    return out


def _known(value: float) -> float | None:
    return None if np.isnan(value) else float(value)


def stream_features(stream: DataFrame, column: str, lags: Mapping[str, int],
                    windows: Mapping[int, tuple[str | None, str | None]], delay: str = "1 hour", ts: str = "ts",
                    keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, ts, column, features) of each hour that the watermark has passed.

    ``lags`` maps names to rows back, ``windows`` rows to the names of their
    mean and deviation. Rows without a time are left out. Hours of one series
    with the same time keep the order of their values.
    """
    ship(stream.sparkSession)
    keys = list(keys)
    back = max([*lags.values(), *windows])
    names = [*lags, *[n for pair in windows.values() for n in pair if n]]
    key_fields = [stream.schema[k] for k in keys]
    out = T.StructType([*key_fields, T.StructField("_us", T.LongType()), T.StructField(column, T.DoubleType()),
                        *[T.StructField(n, T.DoubleType()) for n in names]])
    # Event time in UTC with a zone, as watermarks need it; micros so that nothing is rounded on the way.
    instant = F.col(ts).cast("timestamp")
    rows = stream.where(F.col(ts).isNotNull()).select(
        *keys, instant.alias("_at"), F.unix_micros(instant).alias("_us"), F.col(column).cast("double").alias(column),
        F.lit(1).alias("_one")).withWatermark("_at", delay)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, times, waiting = (np.frombuffer(part, kind) for part, kind in zip(
            state.get if state.exists else (b"", b"", b""), (np.float64, np.int64, np.float64)))
        arrived = [(frame["_us"].to_numpy(np.int64), frame[column].to_numpy(np.float64)) for frame in frames]
        times = np.concatenate([times, *[t for t, _ in arrived]])
        waiting = np.concatenate([waiting, *[v for _, v in arrived]])
        del arrived
        # By time, then value, missing ones last.
        order = np.lexsort((waiting, times))
        times, waiting = times[order], waiting[order]
        del order
        ready = int(np.searchsorted(times, state.getCurrentWatermarkMs() * 1000, "right"))
        values = np.concatenate((past, waiting[:ready]))
        state.update((values[max(0, len(values) - back):].tobytes(), times[ready:].tobytes(), waiting[ready:].tobytes()))
        if ready < len(times):
            # Called again when the watermark has passed the first of those that wait.
            state.setTimeoutTimestamp(max(int(times[ready]) // 1000, state.getCurrentWatermarkMs() + 1))
        times, waiting = times[:ready].copy(), None
        for first in range(0, ready, PART):
            made = []
            for i, time in enumerate(times[first:first + PART].tolist(), first):
                place = len(past) + i
                found = window_features(values[max(0, place - back):place], lags, windows)
                made.append((*key, time, _known(values[place]), *[found[n] for n in names]))
            yield pd.DataFrame(made, columns=out.names).astype({n: "float64" for n in (column, *names)})

    grouped = rows.groupBy(*(keys or ["_one"]))
    # Without keys all rows are one series, grouped by a constant that the result does not have.
    shape = out if keys else T.StructType([T.StructField("_one", T.IntegerType()), *out.fields])
    if not keys:
        out = shape
    made = grouped.applyInPandasWithState(advance, shape, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*keys, F.timestamp_micros("_us").cast(stream.schema[ts].dataType).alias(ts), column, *names)
