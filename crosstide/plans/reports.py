"""Report tables: the data behind charts, exports and look-ups.

Functions take stored tables and return frames; nothing is drawn here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosstide.operators import metrics
from crosstide.operators.backtest import cumulative
from crosstide.operators.ic import FACTORS
from crosstide.operators.positions import exposures
from crosstide.operators.ranking import group_quantiles
from crosstide.operators.selection import STATUSES
from crosstide.operators.timeline import asof_lookup
from crosstide.functions import text

SERIES = ["scenario_id", "rebalance_date"]

# --- distributions -----------------------------------------------------------------


def correlation_matrix(scores: DataFrame, columns: Sequence[str] = tuple(FACTORS.values())) -> DataFrame:
    """Pearson correlation of each pair over rows where all columns are present.

    All pairs come from one aggregate over the rows.
    """
    full = scores.dropna(subset=list(columns))
    pairs = [(a, b) for a in columns for b in columns]
    one = full.agg(
        *[
            F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"c{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(cells))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins from min to max; the last bin is closed."""
    data = df.where(F.col(value).isNotNull())
    span = data.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if not by:
        data, span = data.withColumn("_one", F.lit(1)), span.withColumn("_one", F.lit(1))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1))
    placed = data.join(span, list(by) or ["_one"]).withColumn("bin", F.coalesce(number, F.lit(0)).cast("int"))
    return placed.groupBy(*by, "bin").agg(
        F.min(F.col("_lo") + width * F.col("bin")).alias("bin_start"), F.count(F.lit(1)).alias("n")
    )


def _with_extremes(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], names: Sequence[str], *extra):
    quantiles = group_quantiles(df, by, value, probs)
    ends = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), *extra)
    named = quantiles.select(*by, "n", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    return named.join(ends, list(by))


def distribution(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, extremes, 10th, 50th and 90th percentile per group."""
    return _with_extremes(df, value, by, (0.1, 0.5, 0.9), ("p10", "median", "p90")).select(
        *by, "n", "min", "max", "p10", "median", "p90"
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Extremes, quartiles and mean per group."""
    stats = _with_extremes(df, value, by, (0.25, 0.5, 0.75), ("q1", "median", "q3"), F.avg(value).alias("mean"))
    return stats.select(*by, "n", "min", "q1", "median", "q3", "max", "mean")


# --- return series ------------------------------------------------------------------


def equity_curve(returns: DataFrame) -> DataFrame:
    both = cumulative(cumulative(returns, "net_return", "strategy"), "benchmark_return", "benchmark")
    return both.select(*SERIES, "strategy", "benchmark")


def drawdown_series(returns: DataFrame) -> DataFrame:
    return metrics.drawdowns(returns, "net_return", "drawdown").select(*SERIES, "drawdown")


def monthly_excess(returns: DataFrame) -> DataFrame:
    sign = F.when(F.col("excess_return") >= 0, "positive").when(F.col("excess_return") < 0, "negative")
    return returns.select(*SERIES, "excess_return", sign.alias("sign"))


def cumulative_contribution(returns: DataFrame) -> DataFrame:
    """Running sums of the long and short contributions (a short gains as stocks fall)."""
    w = W.partitionBy("scenario_id").orderBy("rebalance_date").rowsBetween(W.unboundedPreceding, 0)
    return returns.select(
        *SERIES,
        F.sum("long_return").over(w).alias("cumulative_long"),
        F.sum(-F.col("short_return")).over(w).alias("cumulative_short"),
    )


def ic_weight_pivot(weights: DataFrame) -> DataFrame:
    return (
        weights.groupBy("scenario_id", "rebalance_date").pivot("factor_name", list(FACTORS)).agg(F.max("ic_weight"))
    )


def turnover_series(returns: DataFrame) -> DataFrame:
    """Turnover with the scenario mean beside each month."""
    mean = F.avg("turnover").over(W.partitionBy("scenario_id"))
    return returns.select(*SERIES, "turnover", mean.alias("mean_turnover"))


def returns_between(returns: DataFrame, first: str, last: str) -> DataFrame:
    return returns.where(F.col("rebalance_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


# --- scenario tables --------------------------------------------------------------------

# Order and labels of the scenario groups, rows of the summary table.
COST_LABELS = {
    "cost_frictionless": "Frictionless (0 bps)",
    "cost_low": "Low (10 bps)",
    "baseline": "Moderate (25 bps)",
    "cost_high": "High (50 bps)",
}
EXCLUSION_LABELS = {
    "baseline": "Baseline (all 4)",
    "excl_value": "Excl. Value",
    "excl_quality": "Excl. Quality",
    "excl_momentum": "Excl. Momentum",
    "excl_low_vol": "Excl. Low Vol",
}
SUMMARY_ROWS = (
    ("Annualised Return", "annualised_return", "pct"),
    ("Cumulative Return", "cumulative_return", "pct"),
    ("Annualised Volatility", "annualised_volatility", "pct"),
    ("Sharpe Ratio", "sharpe_ratio", "num"),
    ("Sortino Ratio", "sortino_ratio", "num"),
    ("Calmar Ratio", "calmar_ratio", "num"),
    ("Information Ratio", "information_ratio", "num"),
    ("Max Drawdown", "max_drawdown", "pct"),
    ("Tracking Error", "tracking_error", "pct"),
    ("Alpha", "alpha", "pct"),
    ("Benchmark Ann. Return", "benchmark_return_ann", "pct"),
    ("Avg Monthly Turnover", "avg_monthly_turnover", "pct"),
    ("Long Contribution", "long_contribution", "pct"),
    ("Short Contribution", "short_contribution", "pct"),
)
# Metric and whether a higher value is better.
COMPARED = (
    ("annualised_return", True),
    ("cumulative_return", True),
    ("annualised_volatility", False),
    ("sharpe_ratio", True),
    ("sortino_ratio", True),
    ("calmar_ratio", True),
    ("information_ratio", True),
    ("max_drawdown", True),
    ("tracking_error", False),
    ("alpha", True),
    ("avg_monthly_turnover", False),
)


def _labelled(summary: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows of the labelled scenarios with label and position in the list."""
    pairs = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    order = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col("scenario_id"))
    return (
        summary.where(F.col("scenario_id").isin(*labels))
        .withColumn("label", pairs[F.col("scenario_id")])
        .withColumn("position", order)
    )


def _rounded_table(rows: DataFrame, label: str) -> DataFrame:
    percent = lambda c: (F.round(F.col(c) * 100, 2) + F.lit(0.0)).alias(f"{c}_pct")
    plain = lambda c: (F.round(F.col(c), 3) + F.lit(0.0)).alias(c)
    return rows.select(
        "position",
        F.col(label).alias("scenario"),
        percent("annualised_return"),
        plain("sharpe_ratio"),
        plain("sortino_ratio"),
        percent("max_drawdown"),
        percent("alpha"),
        plain("information_ratio"),
    ).orderBy("position", "scenario")


def cost_table(summary: DataFrame) -> DataFrame:
    return _rounded_table(_labelled(summary, COST_LABELS), "label")


def exclusion_table(summary: DataFrame) -> DataFrame:
    return _rounded_table(_labelled(summary, EXCLUSION_LABELS), "label")


def sensitivity_table(summary: DataFrame) -> DataFrame:
    """Baseline first, then the parameter variants by name."""
    rows = summary.where((F.col("scenario_id") == "baseline") | F.col("scenario_id").startswith("sens_"))
    return _rounded_table(rows.withColumn("position", (F.col("scenario_id") != "baseline").cast("bigint")), "scenario_id")


def performance_table(summary: DataFrame, scenario_id: str = "baseline") -> DataFrame:
    """Fourteen formatted metric rows of one scenario."""
    shown = {"pct": text.percent, "num": text.number}
    cells = F.array(
        *[F.struct(F.lit(label).alias("metric"), shown[kind](c).alias("value")) for label, c, kind in SUMMARY_ROWS]
    )
    return summary.where(F.col("scenario_id") == scenario_id).select(F.inline(cells))


def cost_curves(returns: DataFrame) -> DataFrame:
    """Cumulative net return in percent of the cost scenarios."""
    kept = returns.where(F.col("scenario_id").isin(*COST_LABELS))
    curve = cumulative(kept, "net_return", "_c")
    return curve.select(*SERIES, (F.col("_c") * 100).alias("cumulative_pct"))


def sensitivity_bars(summary: DataFrame) -> DataFrame:
    rows = summary.where(F.col("scenario_id").startswith("sens_"))
    return rows.select("scenario_id", "sharpe_ratio", (F.col("alpha") * 100).alias("alpha_pct")).orderBy("scenario_id")


def exclusion_bars(summary: DataFrame) -> DataFrame:
    return _labelled(summary, EXCLUSION_LABELS).select(
        "position", "scenario_id", "label", "sharpe_ratio", (F.col("alpha") * 100).alias("alpha_pct")
    ).orderBy("position")


def compare_scenarios(summary: DataFrame, a: str, b: str) -> DataFrame:
    """Metric by metric: both values, their difference, and which one is better."""
    long = summary.unpivot(["scenario_id"], [m for m, _ in COMPARED], "metric", "value")
    side = long.groupBy("metric").agg(
        F.max(F.when(F.col("scenario_id") == a, F.col("value"))).alias("value_a"),
        F.max(F.when(F.col("scenario_id") == b, F.col("value"))).alias("value_b"),
    )
    better = F.create_map(*[F.lit(v) for kv in COMPARED for v in kv])[F.col("metric")]
    diff = F.col("value_a") - F.col("value_b")
    return side.select(
        "metric", "value_a", "value_b", diff.alias("diff"),
        F.when((diff > 0) == better, "A").otherwise("B").alias("winner"),
    )


def against_baseline(summary: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each parameter value with its Sharpe ratio and return and the change from baseline."""
    kept = ["sharpe_ratio", "annualised_return"]
    base = summary.where(F.col("scenario_id") == "baseline").select(
        F.lit(1).alias("_one"), *[F.col(c).alias(f"_b_{c}") for c in kept]
    )
    rows = parameters.join(summary.select("scenario_id", *kept), "scenario_id").withColumn("_one", F.lit(1))
    return rows.join(base, "_one").select(
        "parameter", "value", "scenario_id", *kept, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"{c}_change") for c in kept]
    )


def scenario_list(summary: DataFrame) -> DataFrame:
    """Scenarios in group order with their display labels."""
    s = F.col("scenario_id")
    group = (
        F.when(s == "baseline", 1)
        .when(s.startswith("cost_"), 2)
        .when(s.startswith("excl_"), 3)
        .when(s.startswith("sens_"), 4)
        .otherwise(5)
    )
    return summary.select(group.alias("group"), "scenario_id", text.scenario_label("scenario_id").alias("label")).orderBy(
        "group", "scenario_id"
    )


def metric_ranking(summary: DataFrame, metric: str) -> DataFrame:
    """One metric across scenarios, ascending."""
    if metric not in metrics.SUMMARY_COLUMNS:
        raise ValueError(f"unknown metric {metric!r}")
    return summary.select("scenario_id", F.col(metric).alias("value")).orderBy("value", "scenario_id")


# --- portfolio tables ----------------------------------------------------------------------


def holdings(positions: DataFrame, universe: DataFrame, date: str | None = None) -> DataFrame:
    """Holdings with security names, by side and falling weight, at one or all dates."""
    rows = positions if date is None else positions.where(F.col("rebalance_date") == F.lit(date).cast("date"))
    return rows.join(universe.select("symbol", "security"), "symbol", "left").orderBy(
        "rebalance_date", "direction", F.col("final_weight").desc(), "symbol"
    )


def history_of(table: DataFrame, symbol: str, order: str) -> DataFrame:
    """All rows of one symbol in date order."""
    return table.where(F.col("symbol") == symbol).orderBy(order)


def sector_breakdown(positions: DataFrame) -> DataFrame:
    """Per date and sector: names and weight by side, and long minus short."""
    w = F.col("final_weight")
    is_long = F.col("direction") == "long"
    return positions.groupBy(*SERIES, "sector").agg(
        F.count_if(is_long).alias("long_names"),
        F.count_if(~is_long).alias("short_names"),
        F.sum(F.when(is_long, w).otherwise(0.0)).alias("long_weight"),
        F.sum(F.when(~is_long, w).otherwise(0.0)).alias("short_weight"),
        F.sum(F.when(is_long, w).otherwise(-F.abs(w))).alias("net_weight"),
    )


def exposure_heatmap(positions: DataFrame) -> DataFrame:
    """Signed sector exposure in percent, long form with zeros for empty cells."""
    signed = F.when(F.col("direction") == "long", F.col("final_weight")).otherwise(-F.abs("final_weight"))
    cells = positions.groupBy("scenario_id", "sector", "rebalance_date").agg((F.sum(signed) * 100).alias("exposure_pct"))
    sectors = cells.groupBy("scenario_id").agg(F.collect_set("sector").alias("sectors"))
    grid = (
        cells.select(*SERIES).distinct().join(sectors, "scenario_id").select(*SERIES, F.explode("sectors").alias("sector"))
    )
    return grid.join(cells, ["scenario_id", "sector", "rebalance_date"], "left").select(
        "scenario_id", "sector", "rebalance_date", F.coalesce("exposure_pct", F.lit(0.0)).alias("exposure_pct")
    )


def status_pivot(selection: DataFrame) -> DataFrame:
    """Number of names in each state by date, zeros included."""
    return selection.groupBy(*SERIES).pivot("status", list(STATUSES)).count().fillna(0)


def latest_portfolio(positions: DataFrame) -> DataFrame:
    """Per scenario: newest date, names held then, and its exposures."""
    per_date = exposures(positions).join(
        positions.groupBy(*SERIES).agg(F.count_distinct("symbol").alias("names")), SERIES
    )
    columns = ["rebalance_date", "names", "long_exposure", "short_exposure", "net_exposure"]
    return per_date.groupBy("scenario_id").agg(
        F.max_by(F.struct(*columns), "rebalance_date").alias("_l")
    ).select("scenario_id", *[F.col(f"_l.{c}").alias(c) for c in columns])


def home_statistics(summary: DataFrame, prices: DataFrame, filings: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: scenarios, investable symbols, months and date span."""
    symbols = prices.select("symbol").intersect(filings.select("symbol"))
    parts = [
        summary.agg(F.count(F.lit(1)).alias("scenarios")),
        symbols.agg(F.count(F.lit(1)).alias("stocks_used")),
        positions.agg(
            F.count_distinct("rebalance_date").alias("months"),
            F.min("rebalance_date").alias("start_date"),
            F.max("rebalance_date").alias("end_date"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def factor_averages(weights: DataFrame) -> DataFrame:
    """Mean IC and weight per factor, and whether the factor is in use."""
    return weights.groupBy("scenario_id", "factor_name").agg(
        F.avg("ic_mean_36m").alias("avg_ic"),
        F.avg("ic_weight").alias("avg_weight"),
        (F.avg("ic_weight") > 0.001).alias("active"),
    ).orderBy("scenario_id", F.col("avg_weight").desc(), "factor_name")


def active_factors(weights: DataFrame) -> DataFrame:
    return factor_averages(weights).where("active").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("active_factors"))


def stock_card(selection: DataFrame) -> DataFrame:
    """Per symbol: latest composite and the months held on each side."""
    scored = F.when(F.col("composite_score").isNotNull(), F.col("rebalance_date"))
    return selection.groupBy("scenario_id", "symbol").agg(
        F.max_by("composite_score", scored).alias("latest_composite"),
        F.count_if(F.col("status").startswith("long")).alias("months_long"),
        F.count_if(F.col("status").startswith("short")).alias("months_short"),
    )


def metric_series(table: DataFrame, columns: Sequence[str], date: str) -> DataFrame:
    """Long (symbol, date, metric, value) series of the chosen columns."""
    unknown = set(columns) - set(table.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return table.unpivot(["symbol", date], list(columns), "metric", "value").where("value is not null")


def price_markers(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Selection events (symbol, rebalance_date, ...) with the last price on or before them."""
    bars = prices.where("adjusted_close is not null").select("symbol", "trade_date", "adjusted_close")
    return asof_lookup(events, bars, ["symbol"], "rebalance_date", "trade_date", ["adjusted_close"])


def all_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every report table of a finished run, by name."""
    returns, summary = tables["backtest_returns"], tables["backtest_summary"]
    held, picked, weights = tables["portfolio_positions"], tables["selection_status"], tables["ic_weights"]
    return {
        "equity_curve": equity_curve(returns),
        "drawdown": drawdown_series(returns),
        "monthly_excess": monthly_excess(returns),
        "long_short_contribution": cumulative_contribution(returns),
        "ic_weights": ic_weight_pivot(weights),
        "rolling_sharpe": metrics.rolling_sharpe(returns),
        "parameter_sensitivity": sensitivity_bars(summary),
        "cost_sensitivity": cost_curves(returns),
        "factor_exclusion": exclusion_bars(summary),
        "monthly_turnover": turnover_series(returns),
        "performance_summary": performance_table(summary),
        "cost_table": cost_table(summary),
        "exclusion_table": exclusion_table(summary),
        "sensitivity_table": sensitivity_table(summary),
        "sector_breakdown": sector_breakdown(held),
        "exposure_heatmap": exposure_heatmap(held),
        "status_counts": status_pivot(picked),
        "factor_averages": factor_averages(weights),
        "stock_card": stock_card(picked),
    }


def write_all(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write every report table as CSV; returns the names."""
    from crosstide.sources.sinks import export_csv

    made = all_tables(tables)
    for name, df in made.items():
        export_csv(df, f"{folder}/{name}")
    return list(made)
