"""Queries on the remaining report tables and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.performance import RETURNS, returns
from crosstide.catalog.portfolio import BOOK, FINAL, SELECT_CTE, plain_positions, selection_table
from crosstide.catalog.registry import FILINGS, MONTH_PANEL, PRICES, RATES, SCORES, UNIVERSE, query, r, tidy, with_
from crosstide.operators import merging, metrics
from crosstide.operators.ic import FACTORS
from crosstide.plans import panels, reports
from crosstide.plans.scenarios import pending, portfolio_scenarios, rules_table

BASE = (UNIVERSE, MONTH_PANEL)

# Mean score of each factor and date stands for an IC weight.
WEIGHTS = """weights AS (SELECT 'baseline' AS scenario_id, score_date AS rebalance_date, factor_name, avg(score) AS ic_mean_36m, avg(score) AS ic_weight
  FROM (SELECT score_date, unnest(['value', 'quality', 'momentum', 'low_vol']) AS factor_name,
          unnest([z_value, z_quality, z_momentum, z_low_vol]) AS score FROM scores) WHERE score IS NOT NULL GROUP BY 2, 3)"""


def weights(spark, sf):
    names = F.create_map(*[F.lit(v) for f, c in FACTORS.items() for v in (c, f)])
    long = panels.month_scores(spark, sf).unpivot(["symbol", "score_date"], list(FACTORS.values()), "column", "score")
    return (
        long.where("score is not null")
        .groupBy(F.col("score_date").alias("rebalance_date"), names[F.col("column")].alias("factor_name"))
        .agg(F.avg("score").alias("ic_weight"))
        .select(F.lit("baseline").alias("scenario_id"), "rebalance_date", "factor_name", F.col("ic_weight").alias("ic_mean_36m"), "ic_weight")
    )


@query(
    "ic_weight_pivot",
    with_(*BASE, SCORES, WEIGHTS, select="SELECT scenario_id, rebalance_date, "
          + ", ".join(f"{r(f'''max(ic_weight) FILTER (factor_name = '{f}')''')} AS {f}" for f in FACTORS) + " FROM weights GROUP BY 1, 2"),
)
def ic_weight_pivot(spark, sf):
    return tidy(reports.ic_weight_pivot(weights(spark, sf)))


@query(
    "factor_averages",
    with_(*BASE, SCORES, WEIGHTS, select=f"""SELECT scenario_id, factor_name, {r('avg(ic_mean_36m)')} AS avg_ic, {r('avg(ic_weight)')} AS avg_weight,
  avg(ic_weight) > 0.001 AS active FROM weights GROUP BY 1, 2"""),
)
def factor_averages(spark, sf):
    return tidy(reports.factor_averages(weights(spark, sf)))


@query(
    "active_factors",
    with_(*BASE, SCORES, WEIGHTS, select="""SELECT scenario_id, count(*) AS active_factors FROM (
  SELECT scenario_id, factor_name FROM weights GROUP BY 1, 2 HAVING avg(ic_weight) > 0.001) GROUP BY 1"""),
)
def active_factors(spark, sf):
    return reports.active_factors(weights(spark, sf))


@query(
    "home_statistics",
    with_(PRICES, FILINGS, *BASE, BOOK, FINAL, RETURNS, select="""SELECT (SELECT count(DISTINCT scenario_id) FROM returns) AS scenarios,
  (SELECT count(*) FROM (SELECT symbol FROM prices INTERSECT SELECT symbol FROM filings)) AS stocks_used,
  count(DISTINCT rebalance_date) AS months, min(rebalance_date) AS start_date, max(rebalance_date) AS end_date FROM pos"""),
)
def home_statistics(spark, sf):
    finished = returns(spark, sf).select("scenario_id").distinct()
    return reports.home_statistics(
        finished, panels.prices(spark, sf), panels.fundamentals(spark, sf), plain_positions(spark, sf)
    )


@query(
    "factor_series",
    with_(*BASE, select=" UNION ALL ".join(
        f"SELECT symbol, calc_date, '{m}' AS metric, {r(m)} AS value FROM month_panel WHERE {m} IS NOT NULL" for m in ("roe", "leverage", "volatility_12m"))),
)
def factor_series(spark, sf):
    return tidy(reports.metric_series(panels.month_panel(spark, sf), ("roe", "leverage", "volatility_12m"), "calc_date"))


@query(
    "position_history",
    with_(*BASE, BOOK, FINAL, select=f"SELECT rebalance_date, direction, {r('final_weight')} AS final_weight FROM pos WHERE symbol = '3'"),
)
def position_history(spark, sf):
    rows = reports.history_of(plain_positions(spark, sf), "3", "rebalance_date")
    return tidy(rows.select("rebalance_date", "direction", "final_weight"))


@query(
    "source_fallback",
    with_(RATES, select=f"""SELECT country, rate_date, {r('CASE WHEN first THEN rate ELSE rate + 1 END')} AS rate, CASE WHEN first THEN 'oecd' ELSE 'yfinance' END AS source
  FROM (SELECT *, country < 'NATION_2' AS first FROM rates)"""),
)
def source_fallback(spark, sf):
    """Countries without rows of the first source take the second one."""
    rates = panels.rates(spark, sf)
    first = rates.where("country < 'NATION_2'").withColumn("source", F.lit("oecd")).withColumn("priority", F.lit(1))
    second = rates.withColumn("rate", F.col("rate") + 1).withColumn("source", F.lit("yfinance")).withColumn("priority", F.lit(2))
    return tidy(merging.first_nonempty_source(first.unionByName(second), ["country"]).drop("priority"))


@query(
    "pending_scenarios",
    with_(RETURNS, select="SELECT count(*) AS pending FROM (SELECT unnest(["
          + ", ".join(f"'{s.scenario_id}'" for s in portfolio_scenarios()) + "]) AS scenario_id) WHERE scenario_id NOT IN (SELECT scenario_id FROM returns)"),
)
def pending_scenarios(spark, sf):
    finished = returns(spark, sf).select("scenario_id").distinct()
    return pending(rules_table(spark, portfolio_scenarios()), finished).agg(F.count(F.lit(1)).alias("pending"))


# --- look-ups of the stock and portfolio pages -------------------------------------------------

STATUS_COLUMNS = "scenario_id, symbol, rebalance_date, sector, status, CAST(buffer_months_count AS INTEGER) AS buffer_months_count, entry_date, exit_reason"
STATUS_NAMES = ("scenario_id", "symbol", "rebalance_date", "sector", "status", "buffer_months_count", "entry_date", "exit_reason")


@query("selection_at_date", with_(*SELECT_CTE, recursive=True, select=f"SELECT {STATUS_COLUMNS} FROM sel WHERE rebalance_date = DATE '1997-06-30'"))
def selection_at_date(spark, sf):
    return selection_table(spark, sf).where("rebalance_date = '1997-06-30'").select(*STATUS_NAMES)


@query("selection_history", with_(*SELECT_CTE, recursive=True, select=f"SELECT {STATUS_COLUMNS} FROM sel WHERE symbol = '3'"))
def selection_history(spark, sf):
    return reports.history_of(selection_table(spark, sf), "3", "rebalance_date").select(*STATUS_NAMES)


@query("all_positions", with_(*BASE, BOOK, FINAL, select=f"SELECT scenario_id, rebalance_date, symbol, sector, direction, {r('final_weight')} AS final_weight FROM pos"))
def all_positions(spark, sf):
    out = reports.holdings(plain_positions(spark, sf), panels.universe(spark, sf))
    return tidy(out.select("scenario_id", "rebalance_date", "symbol", "sector", "direction", "final_weight"))


@query("price_history", with_(PRICES, select=f"SELECT trade_date, {r('ln(adjusted_close)')} AS log_close, volume FROM prices WHERE symbol = '3'"))
def price_history(spark, sf):
    rows = reports.history_of(panels.prices(spark, sf), "3", "trade_date")
    return tidy(rows.select("trade_date", F.log("adjusted_close").alias("log_close"), "volume"))


@query("metric_history", with_(*BASE, select=f"SELECT calc_date, {r('roe')} AS roe, {r('leverage')} AS leverage, {r('volatility_12m')} AS volatility_12m FROM month_panel WHERE symbol = '3'"))
def metric_history(spark, sf):
    rows = reports.history_of(panels.month_panel(spark, sf), "3", "calc_date")
    return tidy(rows.select("calc_date", "roe", "leverage", "volatility_12m"))


@query("score_history", with_(*BASE, SCORES, select="SELECT score_date, " + ", ".join(f"{r(c)} AS {c}" for c in FACTORS.values()) + " FROM scores WHERE symbol = '3'"))
def score_history(spark, sf):
    return tidy(reports.history_of(panels.month_scores(spark, sf), "3", "score_date").drop("symbol"))


@query("scenario_returns", with_(RETURNS, select=f"SELECT rebalance_date, {r('net_return')} AS net_return, {r('turnover')} AS turnover FROM returns WHERE scenario_id = 'baseline'"))
def scenario_returns(spark, sf):
    return tidy(returns(spark, sf).where("scenario_id = 'baseline'").select("rebalance_date", "net_return", "turnover"))


@query("rebalance_dates", with_(*BASE, BOOK, FINAL, select="SELECT DISTINCT scenario_id, rebalance_date FROM pos"))
def rebalance_dates(spark, sf):
    return plain_positions(spark, sf).select("scenario_id", "rebalance_date").distinct()


@query("average_rate", with_(RATES, select=f"SELECT {r('coalesce(avg(rate), 0)')} AS risk_free_rate FROM rates WHERE country = 'NATION_3'"))
def average_rate(spark, sf):
    return tidy(metrics.average_rate(panels.rates(spark, sf), "NATION_3"))
