"""Performance metrics: one row per scenario from its monthly returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Stored summary columns, in order.
SUMMARY_COLUMNS = (
    "scenario_id", "backtest_start", "backtest_end",
    "annualised_return", "cumulative_return", "annualised_volatility", "max_drawdown",
    "downside_deviation", "tracking_error", "sharpe_ratio", "sortino_ratio", "calmar_ratio",
    "information_ratio", "alpha", "benchmark_return_ann", "benchmark_return_cum",
    "benchmark_volatility", "benchmark_max_drawdown", "benchmark_sharpe", "benchmark_sortino",
    "benchmark_calmar", "avg_monthly_turnover", "long_contribution", "short_contribution",
)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def compound(c: str) -> Column:
    return _or_zero(F.product(1 + F.col(c)) - 1)


def annualised(c: str) -> Column:
    """Geometric yearly return; 0 for no rows, null where all wealth was lost."""
    n, growth = F.count(c), F.product(1 + F.col(c))
    yearly = F.pow(F.when(growth >= 0, growth), F.try_divide(F.lit(12.0), n)) - 1
    return F.when(n == 0, 0.0).otherwise(yearly)


def volatility(c: str | Column) -> Column:
    """Yearly sample deviation; 0 below two rows."""
    return _or_zero(F.stddev_samp(c) * 12**0.5)


def downside(c: str, monthly_rate: Column) -> Column:
    shortfall = F.least(F.col(c) - monthly_rate, F.lit(0.0))
    return _or_zero(F.sqrt(F.avg(shortfall * shortfall)) * 12**0.5)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0; null where a part is unknown."""
    return F.when(bottom == 0, 0.0).otherwise(F.try_divide(top, bottom))


def drawdowns(returns: DataFrame, value: str, out: str) -> DataFrame:
    """Fall of compounded wealth from its running peak (the peak starts at the first value)."""
    w = W.partitionBy("scenario_id").orderBy("rebalance_date").rowsBetween(W.unboundedPreceding, 0)
    wealth = F.product(1 + F.col(value)).over(w)
    return (
        returns.withColumn("_wealth", wealth)
        .withColumn("_peak", F.max("_wealth").over(w))
        .withColumn(out, F.when(F.col(value).isNotNull(), F.try_divide(F.col("_wealth") - F.col("_peak"), F.col("_peak"))))
        .drop("_wealth", "_peak")
    )


def average_rate(rates: DataFrame, country: str) -> DataFrame:
    """One row: mean annual rate of a country, 0 if there is none."""
    return rates.where(F.col("country") == country).agg(_or_zero(F.avg("rate")).alias("risk_free_rate"))


def summary_metrics(returns: DataFrame, risk_free_rate: float = 0.0) -> DataFrame:
    """All summary metrics of every scenario in one grouped aggregate."""
    rf = F.lit(float(risk_free_rate))
    monthly = rf / 12
    walked = drawdowns(drawdowns(returns, "net_return", "_dd"), "benchmark_return", "_bdd")
    base = walked.groupBy("scenario_id").agg(
        F.min("rebalance_date").alias("backtest_start"),
        F.max("rebalance_date").alias("backtest_end"),
        annualised("net_return").alias("annualised_return"),
        compound("net_return").alias("cumulative_return"),
        volatility("net_return").alias("annualised_volatility"),
        _or_zero(F.min("_dd")).alias("max_drawdown"),
        downside("net_return", monthly).alias("downside_deviation"),
        volatility(F.col("net_return") - F.col("benchmark_return")).alias("tracking_error"),
        annualised("benchmark_return").alias("benchmark_return_ann"),
        compound("benchmark_return").alias("benchmark_return_cum"),
        volatility("benchmark_return").alias("benchmark_volatility"),
        _or_zero(F.min("_bdd")).alias("benchmark_max_drawdown"),
        downside("benchmark_return", monthly).alias("_bench_down"),
        _or_zero(F.avg("turnover")).alias("avg_monthly_turnover"),
        _or_zero(F.sum("long_return")).alias("long_contribution"),
        _or_zero(F.sum("short_return")).alias("short_contribution"),
    )
    c = F.col
    return (
        base.withColumn("alpha", c("annualised_return") - c("benchmark_return_ann"))
        .withColumn("sharpe_ratio", safe_ratio(c("annualised_return") - rf, c("annualised_volatility")))
        .withColumn("sortino_ratio", safe_ratio(c("annualised_return") - rf, c("downside_deviation")))
        .withColumn("calmar_ratio", safe_ratio(c("annualised_return"), F.abs("max_drawdown")))
        .withColumn("information_ratio", safe_ratio(c("alpha"), c("tracking_error")))
        .withColumn("benchmark_sharpe", safe_ratio(c("benchmark_return_ann") - rf, c("benchmark_volatility")))
        .withColumn("benchmark_sortino", safe_ratio(c("benchmark_return_ann") - rf, c("_bench_down")))
        .withColumn("benchmark_calmar", safe_ratio(c("benchmark_return_ann"), F.abs("benchmark_max_drawdown")))
        .select(*SUMMARY_COLUMNS)
    )


def rolling_sharpe(returns: DataFrame, months: int = 12) -> DataFrame:
    """Trailing annualised mean over deviation; null before a full window."""
    w = W.partitionBy("scenario_id").orderBy("rebalance_date").rowsBetween(1 - months, 0)
    mean, dev = F.avg("net_return").over(w), F.stddev_samp("net_return").over(w)
    value = F.when(F.count("net_return").over(w) == months, F.try_divide(mean * 12, dev * 12**0.5))
    return returns.select("scenario_id", "rebalance_date", value.alias("rolling_sharpe"))
