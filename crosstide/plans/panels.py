"""Equity-shaped panels from trade tables: suppliers or nations as symbols.

A line item is a trade: price = value over quantity, volume = quantity.  Values
are rounded where they are defined, so that every engine starts from the same
numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.dates import business_month_end
from crosstide.operators.backtest import benchmark_returns
from crosstide.operators.crosssection import METRICS
from crosstide.session import in_tasks, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", "trade_date").agg(
        (F.sum("cents") / 100 / F.sum("l_quantity")).alias("adjusted_close"), F.sum("l_quantity").alias("volume")
    )


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with value in cents and rates in percent points: whole numbers
    in doubles, whose sums do not depend on the order of the rows."""
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_quantity",
        "l_returnflag",
        F.to_date("l_shipdate").alias("trade_date"),
        F.round(F.col("l_extendedprice") * 100).alias("cents"),
        F.round(F.col("l_discount") * 100).alias("disc"),
        F.round(F.col("l_tax") * 100).alias("tax"),
    )


def _deviation(total: Column, squares: Column) -> Column:
    """Sample deviation from sums, null below two rows."""
    n = F.count(F.lit(1)).cast("double")
    return F.when(n > 1, F.sqrt(F.try_divide(squares - total * total / n, n - 1)))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier (about one day in five).

    Hardly two trades share a day, so nothing is folded before the exchange: the
    trades are in_tasks by supplier, and bars and windows stay in that placement.
    """
    tasks = tasks_for(spark, table(spark, sf_dir, "lineitem").count())
    trades = _trades(spark, sf_dir).select(F.col("l_suppkey").cast("string").alias("symbol"), "trade_date", "cents", "l_quantity")
    return _bars(in_tasks(trades, tasks, "symbol"))


def prices_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier nation (dense)."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
    trades = _trades(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return _bars(trades.join(nation, F.col("s_nationkey") == F.col("n_nationkey")))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("symbol"),
            F.col("s_name").alias("security"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("country"),
        )
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly filings per supplier."""
    v = F.col("cents")
    quarters = (
        _trades(spark, sf_dir)
        .groupBy(
            F.col("l_suppkey").cast("string").alias("symbol"),
            F.year("trade_date").alias("fiscal_year"),
            F.quarter("trade_date").alias("fiscal_quarter"),
        )
        .agg(
            (F.sum(v) / 100).alias("total_assets"),
            (F.sum(v * F.col("disc")) / 10_000).alias("total_debt"),
            (F.sum(v * (2 * F.col("tax") - F.col("disc"))) / 20_000).alias("net_income"),
            F.sum("l_quantity").cast("bigint").alias("shares_outstanding"),
        )
    )
    end = F.last_day(F.make_date("fiscal_year", F.col("fiscal_quarter") * 3, F.lit(1)))
    return quarters.select(
        "symbol",
        "fiscal_year",
        "fiscal_quarter",
        end.alias("report_date"),
        "total_assets",
        "total_debt",
        "net_income",
        (F.col("total_assets") - F.col("total_debt")).alias("book_equity"),
        "shares_outstanding",
        (F.col("net_income") / F.col("shares_outstanding")).alias("eps"),
    )


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nine-metric panel at month grain: (symbol, sector, calc_date, metrics).

    ROE is left out where no item was returned and leverage where the quantity
    is small, so missing values occur.
    """
    return month_metrics(_trades(spark, sf_dir), universe(spark, sf_dir))


def month_metrics(trades: DataFrame, names: DataFrame) -> DataFrame:
    """``month_panel`` of some trades, with the sectors of ``names``."""
    v, q, d, t = (F.col(c) for c in ("cents", "l_quantity", "disc", "tax"))
    value, quantity, n = F.sum(v), F.sum(q), F.count(F.lit(1))
    monthly = (
        trades
        .groupBy(F.col("l_suppkey").cast("string").alias("symbol"), business_month_end("trade_date").alias("calc_date"))
        .agg(
            (value / 100 / quantity).alias("pb_ratio"),
            ((F.max(v) - F.min(v)) / F.min(v)).alias("asset_growth"),
            F.when(F.count_if(F.col("l_returnflag") == "R") > 0, F.sum(v * (2 * t - d)) / 200 / value).alias("roe"),
            F.when(quantity >= 40, F.sum(v * d) / 100 / value).alias("leverage"),
            _deviation(quantity, F.sum(q * q)).alias("earnings_stability"),
            (F.sum(v * t) / 100 / value).alias("momentum_6m"),
            (F.sum(q * t) / 100 / quantity).alias("momentum_12m"),
            (_deviation(value, F.sum(v * v)) / (value / n)).alias("volatility_3m"),
            (quantity / n).alias("volatility_12m"),
        )
    )
    sectors = names.select("symbol", "sector")
    return monthly.join(sectors, "symbol").select("symbol", "sector", "calc_date", *METRICS)


def month_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor scores at month grain straight from the panel (rounded, some null)."""
    p = month_panel(spark, sf_dir)
    return p.select(
        "symbol",
        F.col("calc_date").alias("score_date"),
        (-F.log("pb_ratio")).alias("z_value"),
        F.col("roe").alias("z_quality"),
        (F.col("momentum_6m") - F.col("momentum_12m")).alias("z_momentum"),
        (-F.col("volatility_12m") / 10).alias("z_low_vol"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end returns of an index of all suppliers."""
    return index_returns(_trades(spark, sf_dir))


def index_returns(trades: DataFrame) -> DataFrame:
    """``benchmark`` of some trades."""
    days = (
        trades
        .groupBy("trade_date")
        .agg((F.sum("cents") / 100 / F.sum("l_quantity")).alias("adjusted_close"))
        .withColumn("benchmark", F.lit("ALL"))
    )
    return benchmark_returns(days)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate per nation and quarter from the average item tax (a decimal fraction)."""
    names = universe(spark, sf_dir).select("symbol", "country")
    quarterly = (
        _trades(spark, sf_dir)
        .withColumn("symbol", F.col("l_suppkey").cast("string"))
        .join(names, "symbol")
        .groupBy("country", F.to_date(F.date_trunc("quarter", "trade_date")).alias("rate_date"))
        .agg((F.sum("tax") / F.count(F.lit(1)) / 100).alias("rate"))
    )
    return quarterly


def month_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long/short book straight from the tables: (scenario_id, rebalance_date,
    symbol, sector, direction, target_weight, adv_20d)."""
    p = month_panel(spark, sf_dir)
    direction = F.when(F.col("momentum_6m") >= 0.04, "long").otherwise("short")
    return p.select(
        F.lit("baseline").alias("scenario_id"),
        F.col("calc_date").alias("rebalance_date"),
        "symbol",
        "sector",
        direction.alias("direction"),
        (F.coalesce("leverage", F.lit(0.04)) / 10).alias("target_weight"),
        (F.col("pb_ratio") * F.col("volatility_12m")).alias("adv_20d"),
    )


def last_month_end(spark: SparkSession, sf_dir: str) -> Column:
    """The last business month end not after the newest trade, as a literal."""
    newest = table(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0]
    day = pd.Timestamp(newest)
    return F.lit((day if day == day + pd.offsets.BMonthEnd(0) else day - pd.offsets.BMonthEnd(1)).date())


# --- the same panels as SQL for the check engine -------------------------------------------


def bme_sql(day: str) -> str:
    """Business month end of a date expression in ANSI-style SQL."""
    last = f"last_day({day})"
    return (
        f"CAST({last} - CAST(CASE dayofweek({last}) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS INTEGER) AS DATE)"
    )
