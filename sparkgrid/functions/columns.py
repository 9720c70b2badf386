"""Column helpers with the missing-value rules of the data model (missing = NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` would skip it)."""
    c = _col(c)
    chain = F
    if lower is not None:
        chain = chain.when(c < lower, F.lit(float(lower)))
    if upper is not None:
        chain = chain.when(c > upper, F.lit(float(upper)))
    return c if chain is F else chain.otherwise(c)


def zero_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def share(condition: Column) -> Column:
    """Per cent of rows that meet a condition; an unknown condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def signed_parts(gap) -> tuple[Column, Column]:
    """Deficit (> 0) and surplus (<= 0) halves of a gap, NULL where the other applies."""
    gap = _col(gap)
    return F.when(gap > 0, gap), F.when(gap <= 0, gap)


def whole(c) -> Column:
    """Magnitude in whole units with thousands separators, halves to even."""
    return F.format_string("%,.0f", F.bround(F.abs(_col(c))))


def signed_whole(c, plus: str = "") -> Column:
    """Like ``whole`` with a sign; ``plus`` is shown for values that are not negative."""
    return F.concat(F.when(_col(c) < 0, "-").otherwise(plus), whole(c))


def time_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
