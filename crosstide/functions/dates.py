"""Business-month calendar as plain column expressions (Mon-Fri, no holidays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def business_month_end(day) -> Column:
    """Last weekday of the calendar month that holds ``day``."""
    last = F.last_day(_c(day))
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))  # 5, 6 = weekend


def shift_month_end(day, months) -> Column:
    """Business month end of the month ``months`` after that of ``day``."""
    return business_month_end(F.add_months(F.trunc(_c(day), "MM"), months))


def month_end_on_or_after(day) -> Column:
    day = _c(day)
    here = business_month_end(day)
    return F.when(day <= here, here).otherwise(shift_month_end(day, 1))


def month_end_after(day) -> Column:
    day = _c(day)
    here = business_month_end(day)
    return F.when(day < here, here).otherwise(shift_month_end(day, 1))


def month_end_before(day, k: int) -> Column:
    """The k-th business month end strictly before ``day``."""
    day = _c(day)
    return F.when(business_month_end(day) < day, shift_month_end(day, 1 - k)).otherwise(
        shift_month_end(day, -k)
    )


def month_number(day) -> Column:
    day = _c(day)
    return F.year(day) * 12 + F.month(day)


def months_between(first, last) -> Column:
    """Array of month starts from the month of ``first`` to that of ``last``."""
    return F.sequence(F.trunc(_c(first), "MM"), F.trunc(_c(last), "MM"), F.expr("interval 1 month"))


def rebalance_calendar(prices: DataFrame, time: str = "trade_date") -> DataFrame:
    """All business month ends inside the date span of ``prices`` (one row each)."""
    span = prices.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    months = span.select(F.explode(months_between("lo", "hi")).alias("month"), "lo", "hi")
    ends = months.select(business_month_end("month").alias("rebalance_date"), "lo", "hi")
    return ends.where("rebalance_date between lo and hi").select("rebalance_date")


def calendar_ending(spark: SparkSession, as_of: str, years: int) -> DataFrame:
    """12 * years + 2 business month ends up to the last one before ``as_of``."""
    last = month_end_before(F.to_date(F.lit(as_of)), 1)
    months = months_between(F.add_months(F.trunc(last, "MM"), -(12 * years + 1)), last)
    return spark.range(1).select(F.explode(months).alias("month")).select(
        business_month_end("month").alias("rebalance_date")
    )


def period_years(text) -> Column:
    """Years in a period text like '10y'; null for 'max' or anything else."""
    return F.regexp_extract(F.lower(F.trim(_c(text))), r"^(\d+)y$", 1).try_cast("int")
