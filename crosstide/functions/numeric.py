"""Arithmetic with nulls instead of NaN, infinities and division errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finite(col) -> Column:
    """Null where the value is NaN or infinite."""
    col = _c(col)
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def null_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column (done at each input boundary)."""
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def ratio(top, bottom) -> Column:
    return F.try_divide(_c(top), _c(bottom))


def log_change(now, before) -> Column:
    now, before = _c(now), _c(before)
    return F.when((now > 0) & (before > 0), F.log(now / before))


def clip(col, low, high) -> Column:
    return F.least(F.greatest(_c(col), _c(low)), _c(high))


def mean_of(columns: list[str]) -> Column:
    """Row mean over the non-null columns; null if all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.when(present > 0, total / present)


def rounded(col, digits: int = 6) -> Column:
    """Rounded value without a negative zero."""
    return F.round(_c(col), digits) + F.lit(0.0)
