"""Solar and wind generation from profiles, where the measured columns follow capacity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.constants import MIN_PROFILE_ROWS, SOLAR_PEAK_MW, WIND_PEAK_MW
from sparkgrid.functions.columns import clip
from sparkgrid.operators.clean import usable
from sparkgrid.operators.fill import Fill, fill_ordered
from sparkgrid.operators.ordered import POS, SIZE, with_position
from sparkgrid.session import join_small, one_row, stage


def reconstruct(df: DataFrame, mode: str = "capacity", ts: str = "ts", keys: Iterable[str] = (),
                min_rows: int = MIN_PROFILE_ROWS, solar_peak: float = SOLAR_PEAK_MW,
                wind_peak: float = WIND_PEAK_MW) -> DataFrame:
    """Add solar_gen and wind_gen, never below 0.

    ``capacity``  profile × installed capacity, capacity filled forward; if either
                  profile is nearly empty, the measured solar_raw / wind_raw instead
    ``peak``      profile × fixed peak; a profile that exceeds 1 is divided by its
                  maximum first. Capacity is filled in both directions.

    Whether a profile is usable, and its maximum, are found per series.

    Train and score with the same mode: the models learn its scale.
    """
    keys = list(keys)
    # Written once in order; the profile checks read their two columns of it.
    ordered = with_position(df, ts, keys)
    if mode == "capacity":
        filled = fill_ordered(ordered, {"solar_cap": Fill("forward"), "wind_cap": Fill("forward")}).drop(POS, SIZE)
        flag = _with_row(filled, usable(ordered.df, "solar_profile", "wind_profile", min_rows, keys), "_ok", keys)
        from_profile = F.col("_ok.usable")
        return flag.withColumns({
            "solar_gen": clip(F.when(from_profile, F.col("solar_profile") * F.col("solar_cap"))
                              .otherwise(F.col("solar_raw")), 0),
            "wind_gen": clip(F.when(from_profile, F.col("wind_profile") * F.col("wind_cap"))
                             .otherwise(F.col("wind_raw")), 0),
        }).drop("_ok")
    if mode == "peak":
        filled = fill_ordered(ordered, {"solar_cap": Fill("both"), "wind_cap": Fill("both")}).drop(POS, SIZE)
        return scale_to_peak(filled, ordered.df, solar_peak, wind_peak, keys)
    raise ValueError(f"unknown mode {mode!r}")


def _with_row(df: DataFrame, small: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Add the one row of ``small``, or the row of the same series, as a struct."""
    if not keys:
        return df.withColumn(name, one_row(small))
    values = [c for c in small.columns if c not in keys]
    # Measured and then joined: computed once.
    return join_small(df, stage(small.select(*keys, F.struct(*values).alias(name)), "series"), keys)


def scale_to_peak(df: DataFrame, source: DataFrame, solar_peak: float = SOLAR_PEAK_MW,
                  wind_peak: float = WIND_PEAK_MW, keys: Iterable[str] = ()) -> DataFrame:
    """Profiles scaled to fixed peaks; the maxima come from ``source`` (its two profile columns only)."""
    keys = list(keys)
    tops = source.groupBy(*keys).agg(F.max("solar_profile").alias("solar"), F.max("wind_profile").alias("wind"))
    df = _with_row(df, tops, "_top", keys)
    scaled = {}
    for kind, peak in (("solar", solar_peak), ("wind", wind_peak)):
        profile, top = F.col(f"{kind}_profile"), F.col(f"_top.{kind}")
        unit = F.when(top > 1, profile / F.nullif(top, F.lit(0.0))).otherwise(profile)
        scaled[f"{kind}_gen"] = clip(unit * peak, 0)
    return df.withColumns(scaled).drop("_top")
