"""The whole run as a chain of set-based stages over (scenario, date, symbol)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.dates import month_end_before
from crosstide.operators import backtest, crosssection, fundamentals, ic, metrics, positions, rolling, selection, timeline
from crosstide.operators.ranking import rank_pct
from crosstide.plans.scenarios import Liquidity, Rules, Settings, cost_table, portfolio_scenarios, rules_table
from crosstide.session import in_tasks, last_table_stays, materialize, settle, stored, tasks_for


@dataclass(frozen=True)
class Inputs:
    """Source frames.  ``universe`` needs symbol and sector, ``rates`` country,
    rate_date and rate, ``benchmark`` month_end and monthly_return."""

    prices: DataFrame
    filings: DataFrame
    rates: DataFrame
    universe: DataFrame
    benchmark: DataFrame


def liquidity_screen(prices: DataFrame, last_date: Column, config: Liquidity = Liquidity()) -> DataFrame:
    """Liquidity measures, ranks and pass flags of every name with a full history."""
    measured = timeline.trailing_liquidity(
        prices, last_date, config.adtv_rows, config.illiq_rows, config.window_days
    ).where(F.col("adtv").isNotNull())
    passes = F.col("adtv") >= config.adtv_min_dollar
    flagged = measured.withColumn("passes_adv", passes).withColumn(
        "amihud_illiq", F.when(passes, F.col("amihud_illiq"))
    )
    ranked = rank_pct(flagged, ["calc_date"], "amihud_illiq", "illiq_rank_pct")
    liquid = F.coalesce(F.col("illiq_rank_pct") <= 1.0 - config.illiq_removal_pct, F.lit(False))
    return ranked.select(
        "symbol",
        "calc_date",
        F.col("adtv").alias("adv_20d"),
        "amihud_illiq",
        "illiq_rank_pct",
        "passes_adv",
        liquid.alias("passes_illiq"),
        (F.col("passes_adv") & liquid).alias("passes_filter"),
    )


def short_rates(rates: DataFrame, calendar: DataFrame, country: str) -> DataFrame:
    """Last known annual rate of a country at each calendar date; 0 without one."""
    one = rates.where(F.col("country") == country).select("country", "rate_date", "rate")
    probes = calendar.select(F.lit(country).alias("country"), F.col("rebalance_date").alias("calc_date"))
    found = timeline.asof_lookup(probes, one, ["country"], "calc_date", "rate_date", ["rate"])
    return found.select("calc_date", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def metric_panel(
    prices: DataFrame, filings: DataFrame, rates: DataFrame, calendar: DataFrame, last_date: Column, country: str
) -> DataFrame:
    """Nine raw metrics per (symbol, date).

    The four metric families are stacked and folded by one grouped aggregate
    instead of being joined one after the other.  ``prices`` and ``filings`` are
    stored tables, read more than once; the number of tasks follows the prices, as
    every family makes far more rows of a symbol than it reads.
    """
    tasks = tasks_for(prices.sparkSession, prices.count())
    prices = in_tasks(prices, tasks, "symbol")
    month_prices = timeline.month_end_prices(prices, last_date)
    held = fundamentals.latest_filing(in_tasks(filings, tasks, "symbol"), last_date)
    accounts = fundamentals.price_to_book(
        fundamentals.accounting_ratios(fundamentals.prior_year_filing(held, filings, tasks=tasks)),
        month_prices,
        month_end_before("calc_date", 16),
        tasks,
    )
    families = (
        accounts.select("symbol", "calc_date", "pb_ratio", "asset_growth", "roe", "leverage"),
        fundamentals.earnings_stability(filings, last_date, tasks=tasks),
        timeline.momentum(month_prices, short_rates(rates, calendar, country)),
        rolling.realised_volatility(prices, last_date).select(
            "symbol", "calc_date", "volatility_3m", "volatility_12m"
        ),
    )
    stacked = families[0]
    for family in families[1:]:
        stacked = stacked.unionByName(family, allowMissingColumns=True)
    return in_tasks(stacked, tasks, "symbol", "calc_date").groupBy("symbol", "calc_date").agg(*[F.max(m).alias(m) for m in crosssection.METRICS])


def score_panel(panel: DataFrame, min_pairs: int = crosssection.MIN_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(metric z-scores, factor scores) of a raw metric panel with sectors."""
    z = crosssection.sector_zscores(stored(crosssection.winsorise(panel), "winsorised"))
    scored = crosssection.orthogonalise(crosssection.factor_scores(z), min_pairs=min_pairs)
    return z, scored.select(
        "symbol",
        F.col("calc_date").alias("score_date"),
        F.col("value_score").alias("z_value"),
        F.col("quality_score").alias("z_quality"),
        F.col("momentum_score").alias("z_momentum"),
        F.col("lowvol_score").alias("z_low_vol"),
    )


def ic_and_composite(
    scores: DataFrame, prices: DataFrame, calendar: DataFrame, scenarios: list[Rules], min_months: int
) -> tuple[DataFrame, DataFrame]:
    """IC weights and composite scores of every scenario and date.

    The scenarios are a literal list, so they are spread over the calendar
    without a join.  Dates up to the first score have no composite.
    """
    first = scores.agg(F.min("score_date")).first()[0]
    runs = F.array(
        *[
            F.struct(
                F.lit(s.scenario_id).alias("scenario_id"),
                F.lit(s.ic_lookback_months).alias("ic_lookback_months"),
                F.lit(s.excluded_factor).cast("string").alias("excluded_factor"),
            )
            for s in scenarios
        ]
    )
    active = calendar.where(F.col("rebalance_date") > F.lit(first)).select("rebalance_date", F.inline(runs))
    with last_table_stays(scores.sparkSession):
        ics = ic.ic_as_of(scores, prices, calendar, [s.ic_lookback_months for s in scenarios])
        weights = materialize(ic.ic_weights(ics, active, min_months), "ic-weights")
    return weights, ic.composite_scores(scores, weights)


def build_positions(
    composite: DataFrame,
    prices: DataFrame,
    universe: DataFrame,
    rules: DataFrame,
    lambdas: list[float],
    last_date: Column,
    settings: Settings,
) -> tuple[DataFrame, DataFrame]:
    """(selection status, portfolio positions) of every scenario and date."""
    picked = stored(selection.select_names(selection.sector_ranks(composite, universe), rules), "selection")
    vols = rolling.ewma_volatility(prices, last_date, lambdas, settings.ewma_window_days, settings.ewma_seed)
    scored = stored(positions.risk_adjusted(selection.selected(picked).drop("ord"), vols, rules), "scored")
    adv = timeline.trailing_liquidity(
        prices, last_date, settings.liquidity.adtv_rows, 1, settings.liquidity.sizing_window_days
    ).select("symbol", F.col("calc_date").alias("rebalance_date"), F.col("adtv").alias("adv_20d"))
    with last_table_stays(prices.sparkSession):
        capped = materialize(positions.liquidity_cap(positions.sector_weights(scored), adv, rules), "capped")
    with last_table_stays(prices.sparkSession):
        held = positions.no_trade_zone(capped, rules).select(
            "scenario_id", "rebalance_date", "symbol", "sector", "direction", "ewma_vol", "risk_adj_score",
            "target_weight", "final_weight", "liquidity_capped", "trade_action",
        )
        held = materialize(held, "positions")
    return picked, held


def backtest_all(
    held: DataFrame, prices: DataFrame, benchmark: DataFrame, costs: DataFrame, last_date: Column, drift: str
) -> DataFrame:
    """Returns of every scenario, cost variants included."""
    month_prices = timeline.month_end_prices(prices, last_date)
    totals = settle(backtest.period_totals(backtest.holding_returns(held, month_prices), drift))
    return backtest.with_costs(totals, costs, benchmark)


def run(
    spark: SparkSession,
    inputs: Inputs,
    calendar: DataFrame,
    scenarios: list[Rules] | None = None,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """All stored tables of a full run, stage by stage.

    A stage ends with a stored table, and the shuffle files of the stages before are
    gone by then, so disk holds what one stage shuffles and the tables.
    """
    scenarios = scenarios or portfolio_scenarios()
    calendar = settle(calendar)
    prices = in_tasks(inputs.prices, tasks_for(spark, inputs.prices.count()), "symbol")
    last = F.lit(calendar.agg(F.max("rebalance_date")).first()[0])
    rules = rules_table(spark, scenarios)

    liquidity = stored(liquidity_screen(prices, last, settings.liquidity), "liquidity")
    raw = metric_panel(inputs.prices, inputs.filings, inputs.rates, calendar, last, settings.country)
    panel = stored(
        liquidity.where("passes_filter")
        .select("symbol", "calc_date")
        .join(inputs.universe.select("symbol", "sector"), "symbol")
        .join(raw, ["symbol", "calc_date"], "left"),
        "metric-panel",
    )
    zscores, scores = score_panel(panel, settings.min_ols_pairs)
    scores = stored(scores, "factor-scores")
    weights, composite = ic_and_composite(scores, prices, calendar, scenarios, settings.min_ic_months)
    composite = stored(composite, "composite")
    lambdas = sorted({s.ewma_lambda for s in scenarios})
    picked, held = build_positions(composite, prices, inputs.universe, rules, lambdas, last, settings)
    returns = settle(
        backtest_all(
            held, prices, inputs.benchmark, cost_table(spark, scenarios), last, settings.turnover_drift
        )
    )
    risk_free = settings.risk_free_rate
    if risk_free is None:
        risk_free = metrics.average_rate(inputs.rates, settings.country).first()[0]
    return {
        "liquidity_metrics": liquidity,
        "factor_metrics": panel,
        "factor_zscores": zscores,
        "factor_scores": scores,
        "ic_weights": weights,
        "composite_scores": composite,
        "selection_status": picked,
        "portfolio_positions": held,
        "constraints": positions.constraint_check(held, settings.constraint_tolerance),
        "benchmark_returns": inputs.benchmark,
        "backtest_returns": returns,
        "backtest_summary": metrics.summary_metrics(returns, risk_free),
    }
