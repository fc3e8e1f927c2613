"""Point-in-time operators on per-symbol series.

A series holds at most one row per (symbol, day), so a window over one symbol
is bounded by the trading calendar, whatever the size of the universe.  Rows
are spread over rebalance dates *after* the shuffle by symbol, inside the same
stage, so wide look-backs cost CPU but no extra network traffic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosstide.functions.dates import (
    business_month_end,
    month_end_after,
    month_end_on_or_after,
    months_between,
    shift_month_end,
)
from crosstide.functions.numeric import log_change, ratio

TIME_BUCKETS = 32  # of a key in an as-of look-up


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the greatest ``order`` tuple per key.

    An aggregate, not a row number: partial maxima are taken before the
    shuffle, so a key with very many copies never reaches one task whole.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def asof_lookup(
    probes: DataFrame,
    series: DataFrame,
    key: Sequence[str],
    probe_time: str,
    series_time: str,
    values: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Attach to each probe the last series row at (or strictly before) its time.

    Union of both sides plus a running ``last``; no inequality join.  A key is
    cut into time buckets of about equal size, the running value is formed inside
    a bucket, and what a bucket inherits comes from a running value over the last
    rows of the earlier buckets.  So a key with very many rows fills no task.
    """
    key = list(key)
    probe_side, series_side = (0, 1) if strict else (1, 0)
    right = series.select(
        *key,
        F.col(series_time).alias("_t"),
        F.lit(series_side).alias("_side"),
        F.struct(F.col(series_time).alias("_at"), *values).alias("_v"),
        F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_p"),
    )
    left = probes.select(
        *key,
        F.col(probe_time).alias("_t"),
        F.lit(probe_side).alias("_side"),
        F.lit(None).cast(right.schema["_v"].dataType).alias("_v"),
        F.struct("*").alias("_p"),
    )
    rows = right.unionByName(left)
    at = F.array(*[F.lit(i / TIME_BUCKETS) for i in range(1, TIME_BUCKETS)])
    cuts = rows.groupBy(*key).agg(F.percentile_approx("_t", at, F.lit(20 * TIME_BUCKETS)).alias("_cuts"))
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))
    placed = rows.join(cuts, key).withColumn("_bucket", bucket).drop("_cuts")
    ends = placed.groupBy(*key, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inherited = ends.select(*key, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_inherited"))
    running = W.partitionBy(*key, "_bucket").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(inherited, [*key, "_bucket"])
        .withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(running), F.col("_inherited")))
        .where(F.col("_p").isNotNull())
        .select("_p.*", F.col("_v._at").alias(f"asof_{series_time}"), *[F.col(f"_v.{v}").alias(v) for v in values])
    )


def _spread(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """One row per business month end in ``[first, last]``; none if there is none.

    ``first`` is a month end itself.  Bounds become columns before they are
    used, so that the date arithmetic is computed once per row; rows without a
    date are dropped before anything is exploded.
    """
    bounded = df.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    months = bounded.withColumn("_month", F.explode(months_between("_first", "_last")))
    return months.withColumn(out, business_month_end("_month")).where(F.col(out) <= F.col("_last")).drop(
        "_first", "_last", "_month"
    )


def month_end_prices(prices: DataFrame, last_date: Column) -> DataFrame:
    """Price on or before every business month end, with the date it was set.

    Days are folded to their month end before the shuffle; a price then stands
    until the next month end that has a newer one.
    """
    folded = (
        prices.where(F.col("adjusted_close").isNotNull())
        .groupBy("symbol", month_end_on_or_after("trade_date").alias("period"))
        .agg(F.max_by("adjusted_close", "trade_date").alias("price"), F.max("trade_date").alias("price_date"))
    )
    following = F.lead("period").over(W.partitionBy("symbol").orderBy("period"))
    held = folded.withColumn("_until", F.coalesce(F.date_sub(following, 1), last_date))
    return _spread(held, F.col("period"), F.least(F.col("_until"), last_date), "calc_date").select(
        "symbol", "calc_date", "price_date", "price"
    )


def monthly_returns(prices: DataFrame) -> DataFrame:
    """Return of the last price of a month over that of the previous month traded."""
    months = (
        prices.where(F.col("adjusted_close").isNotNull())
        .groupBy("symbol", F.trunc("trade_date", "MM").alias("month"))
        .agg(F.max_by("adjusted_close", "trade_date").alias("close"), F.max("trade_date").alias("end_date"))
    )
    by_symbol = W.partitionBy("symbol").orderBy("month")
    return months.select(
        "symbol",
        F.last_day("month").alias("month_end"),
        "end_date",
        F.lag("end_date").over(by_symbol).alias("base_date"),
        (ratio("close", F.lag("close").over(by_symbol)) - 1).alias("monthly_return"),
    ).where(F.col("monthly_return").isNotNull())


def trailing_liquidity(
    prices: DataFrame,
    last_date: Column,
    adv_rows: int = 20,
    illiq_rows: int = 21,
    window_days: int = 42,
) -> DataFrame:
    """Average traded value and price impact at each month end d.

    Uses the newest rows before d and requires all of them to lie in
    ``[d - window_days, d)``; otherwise the measure is null.
    """
    base = prices.where(F.col("adjusted_close").isNotNull() & (F.col("volume") > 0))
    w = W.partitionBy("symbol").orderBy("trade_date")
    adv_frame, illiq_frame = w.rowsBetween(1 - adv_rows, 0), w.rowsBetween(1 - illiq_rows, 0)
    rolled = (
        base.select("symbol", "trade_date", "adjusted_close", (F.col("adjusted_close") * F.col("volume")).alias("dv"))
        .withColumn("impact", ratio(F.abs(log_change("adjusted_close", F.lag("adjusted_close").over(w))), "dv"))
        .withColumn("adtv", F.when(F.count("dv").over(adv_frame) == adv_rows, F.avg("dv").over(adv_frame)))
        .withColumn(
            "amihud_illiq",
            F.when(F.count("impact").over(illiq_frame) == illiq_rows, F.avg("impact").over(illiq_frame)),
        )
        .withColumn("adv_from", F.lag("trade_date", adv_rows - 1).over(w))
        .withColumn("illiq_from", F.lag("trade_date", illiq_rows).over(w))
        .withColumn("next_date", F.lead("trade_date").over(w))
    )
    reach = F.date_add("trade_date", window_days)
    until = F.least(F.coalesce(F.col("next_date"), reach), reach, last_date)
    stamped = _spread(rolled, month_end_after("trade_date"), until, "calc_date")
    start = F.date_sub("calc_date", window_days)
    return stamped.select(
        "symbol",
        "calc_date",
        F.when(F.col("adv_from") >= start, F.col("adtv")).alias("adtv"),
        F.when(F.col("illiq_from") >= start, F.col("amihud_illiq")).alias("amihud_illiq"),
    )


def momentum(month_prices: DataFrame, short_rates: DataFrame, skip: int = 1, months_back: int = 16) -> DataFrame:
    """Skip-month momentum over 6 and 12 months in excess of the monthly rate.

    ``month_prices`` is the dense output of :func:`month_end_prices`;
    ``short_rates`` has one annual ``rate`` per ``calc_date``.
    """
    w = W.partitionBy("symbol").orderBy("calc_date")
    oldest = shift_month_end("calc_date", -months_back)

    def at(k: int) -> Column:
        return F.when(F.lag("price_date", k).over(w) >= oldest, F.lag("price", k).over(w))

    reached = month_prices.select(
        "symbol", "calc_date", at(skip).alias("p1"), at(skip + 6).alias("p7"), at(skip + 12).alias("p13")
    )
    monthly = F.pow(1 + F.coalesce(F.col("rate"), F.lit(0.0)), F.lit(1.0 / 12)) - 1
    return reached.join(short_rates.select("calc_date", "rate"), "calc_date", "left").select(
        "symbol",
        "calc_date",
        F.when(F.col("p7") > 0, F.col("p1") / F.col("p7") - 1 - monthly).alias("momentum_6m"),
        F.when(F.col("p13") > 0, F.col("p1") / F.col("p13") - 1 - monthly).alias("momentum_12m"),
    )
