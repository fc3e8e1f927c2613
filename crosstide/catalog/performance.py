"""Queries on return series, summaries and report tables.

Regions stand for scenarios: monthly returns are small averages of item rates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.registry import query, r, tidy, with_
from crosstide.functions import text
from crosstide.operators import metrics
from crosstide.operators.backtest import cumulative
from crosstide.plans import panels, reports
from crosstide.plans.scenarios import parameter_map
from crosstide.session import settle

# The scenario names the regions stand for.
NAMES = {
    "AFRICA": "baseline",
    "AMERICA": "cost_frictionless",
    "ASIA": "cost_high",
    "EUROPE": "excl_value",
    "MIDDLE EAST": "sens_sel_0.05",
}
NAMED = "CASE r_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE r_name END"

RETURNS = f"""returns AS (
  SELECT {NAMED} AS scenario_id, CAST(last_day(CAST(l_shipdate AS DATE)) AS DATE) AS rebalance_date,
    sum(round(l_discount * 100)) / 100 / count(*) - 0.05::DOUBLE AS net_return,
    sum(round(l_tax * 100)) / 100 / count(*) - 0.04::DOUBLE AS benchmark_return,
    sum(round(l_discount * 100)) / 200 / count(*) AS long_return,
    sum(round(l_tax * 100)) / 200 / count(*) AS short_return,
    (count(*) FILTER (l_returnflag = 'R'))::DOUBLE / count(*) AS turnover
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2)"""


def returns(spark, sf):
    nations = panels.table(spark, sf, "nation").join(
        panels.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    places = panels.table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    names = F.create_map(*[F.lit(v) for kv in NAMES.items() for v in kv])
    n = F.count(F.lit(1))
    disc, tax = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    return settle(
        panels.table(spark, sf, "lineitem")
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.coalesce(F.try_element_at(names, F.col("r_name")), F.col("r_name")).alias("scenario_id"),
            F.last_day(F.to_date("l_shipdate")).alias("rebalance_date"),
        )
        .agg(
            (F.sum(disc) / 100 / n - 0.05).alias("net_return"),
            (F.sum(tax) / 100 / n - 0.04).alias("benchmark_return"),
            (F.sum(disc) / 200 / n).alias("long_return"),
            (F.sum(tax) / 200 / n).alias("short_return"),
            (F.count_if(F.col("l_returnflag") == "R") / n).alias("turnover"),
        )
        .withColumn("excess_return", F.col("net_return") - F.col("benchmark_return"))
    )


OVER = "OVER (PARTITION BY scenario_id ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING)"
CURVES = f"""curves AS (SELECT *, product(1 + net_return) {OVER} AS wealth, product(1 + benchmark_return) {OVER} AS bwealth FROM returns),
peaks AS (SELECT *, max(wealth) {OVER} AS peak, max(bwealth) {OVER} AS bpeak FROM curves)"""


@query("equity_curve", with_(RETURNS, CURVES, select=f"SELECT scenario_id, rebalance_date, {r('wealth - 1')} AS strategy, {r('bwealth - 1')} AS benchmark FROM curves"))
def equity_curve(spark, sf):
    return tidy(reports.equity_curve(returns(spark, sf)))


@query("drawdown", with_(RETURNS, CURVES, select=f"SELECT scenario_id, rebalance_date, {r('(wealth - peak) / peak')} AS drawdown FROM peaks"))
def drawdown(spark, sf):
    return tidy(reports.drawdown_series(returns(spark, sf)))


@query(
    "monthly_excess",
    with_(RETURNS, select=f"""SELECT scenario_id, rebalance_date, {r('net_return - benchmark_return')} AS excess_return,
  CASE WHEN net_return - benchmark_return >= 0 THEN 'positive' ELSE 'negative' END AS sign FROM returns"""),
)
def monthly_excess(spark, sf):
    return tidy(reports.monthly_excess(returns(spark, sf)))


@query(
    "cumulative_contribution",
    with_(RETURNS, select=f"SELECT scenario_id, rebalance_date, {r(f'sum(long_return) {OVER}')} AS cumulative_long, {r(f'sum(-short_return) {OVER}')} AS cumulative_short FROM returns"),
)
def cumulative_contribution(spark, sf):
    return tidy(reports.cumulative_contribution(returns(spark, sf)))


@query(
    "rolling_sharpe",
    with_(RETURNS, select=f"""SELECT scenario_id, rebalance_date,
  {r('CASE WHEN count(*) OVER w = 12 THEN avg(net_return) OVER w * 12 / nullif(stddev_samp(net_return) OVER w * sqrt(12), 0) END')} AS rolling_sharpe
  FROM returns WINDOW w AS (PARTITION BY scenario_id ORDER BY rebalance_date ROWS 11 PRECEDING)"""),
)
def rolling_sharpe(spark, sf):
    return tidy(metrics.rolling_sharpe(returns(spark, sf)))


@query("turnover_series", with_(RETURNS, select=f"SELECT scenario_id, rebalance_date, {r('turnover')} AS turnover, {r('avg(turnover) OVER (PARTITION BY scenario_id)')} AS mean_turnover FROM returns"))
def turnover_series(spark, sf):
    return tidy(reports.turnover_series(returns(spark, sf)))


RF = 0.02
SUMMARY = f"""agg AS (SELECT scenario_id, min(rebalance_date) AS backtest_start, max(rebalance_date) AS backtest_end,
  pow(product(1 + net_return), 12.0 / count(*)) - 1 AS annualised_return, product(1 + net_return) - 1 AS cumulative_return,
  coalesce(stddev_samp(net_return), 0) * sqrt(12) AS annualised_volatility, min((wealth - peak) / peak) AS max_drawdown,
  sqrt(avg(pow(least(net_return - {RF}/12, 0), 2))) * sqrt(12) AS downside_deviation,
  coalesce(stddev_samp(net_return - benchmark_return), 0) * sqrt(12) AS tracking_error,
  pow(product(1 + benchmark_return), 12.0 / count(*)) - 1 AS benchmark_return_ann, product(1 + benchmark_return) - 1 AS benchmark_return_cum,
  coalesce(stddev_samp(benchmark_return), 0) * sqrt(12) AS benchmark_volatility, min((bwealth - bpeak) / bpeak) AS benchmark_max_drawdown,
  sqrt(avg(pow(least(benchmark_return - {RF}/12, 0), 2))) * sqrt(12) AS bdown,
  avg(turnover) AS avg_monthly_turnover, sum(long_return) AS long_contribution, sum(short_return) AS short_contribution
  FROM peaks GROUP BY 1),
summary AS (SELECT *, annualised_return - benchmark_return_ann AS alpha,
  coalesce((annualised_return - {RF}) / nullif(annualised_volatility, 0), 0) AS sharpe_ratio,
  coalesce((annualised_return - {RF}) / nullif(downside_deviation, 0), 0) AS sortino_ratio,
  coalesce(annualised_return / nullif(abs(max_drawdown), 0), 0) AS calmar_ratio,
  coalesce((annualised_return - benchmark_return_ann) / nullif(tracking_error, 0), 0) AS information_ratio,
  coalesce((benchmark_return_ann - {RF}) / nullif(benchmark_volatility, 0), 0) AS benchmark_sharpe,
  coalesce((benchmark_return_ann - {RF}) / nullif(bdown, 0), 0) AS benchmark_sortino,
  coalesce(benchmark_return_ann / nullif(abs(benchmark_max_drawdown), 0), 0) AS benchmark_calmar FROM agg)"""
SUM = (RETURNS, CURVES, SUMMARY)


def summary(spark, sf):
    return metrics.summary_metrics(returns(spark, sf), RF)


@query(
    "summary_metrics",
    with_(*SUM, select="SELECT scenario_id, backtest_start, backtest_end, " + ", ".join(f"{r(c)} AS {c}" for c in metrics.SUMMARY_COLUMNS[3:]) + " FROM summary"),
)
def summary_metrics(spark, sf):
    return tidy(summary(spark, sf))


TABLE_COLUMNS = ", ".join(
    [f"{r('annualised_return * 100', 2)} AS annualised_return_pct", f"{r('sharpe_ratio', 3)} AS sharpe_ratio", f"{r('sortino_ratio', 3)} AS sortino_ratio",
     f"{r('max_drawdown * 100', 2)} AS max_drawdown_pct", f"{r('alpha * 100', 2)} AS alpha_pct", f"{r('information_ratio', 3)} AS information_ratio"]
)


def _label_sql(labels: dict[str, str]) -> str:
    rows = ", ".join(f"({i + 1}, '{k}', '{v}')" for i, (k, v) in enumerate(labels.items()))
    return f"(VALUES {rows}) t(position, id, label)"


def _table_sql(labels: dict[str, str]) -> str:
    return with_(*SUM, select=f"SELECT CAST(position AS BIGINT) AS position, label AS scenario, {TABLE_COLUMNS} FROM summary JOIN {_label_sql(labels)} ON scenario_id = id")


@query("cost_table", _table_sql(reports.COST_LABELS))
def cost_table(spark, sf):
    return reports.cost_table(summary(spark, sf))


@query("exclusion_table", _table_sql(reports.EXCLUSION_LABELS))
def exclusion_table(spark, sf):
    return reports.exclusion_table(summary(spark, sf))


@query(
    "sensitivity_table",
    with_(*SUM, select=f"""SELECT CAST(CASE scenario_id WHEN 'baseline' THEN 0 ELSE 1 END AS BIGINT) AS position, scenario_id AS scenario, {TABLE_COLUMNS}
  FROM summary WHERE scenario_id = 'baseline' OR starts_with(scenario_id, 'sens_')"""),
)
def sensitivity_table(spark, sf):
    return reports.sensitivity_table(summary(spark, sf))


def _shown_sql(column: str, kind: str) -> str:
    return f"printf('%.2f%%', {column} * 100)" if kind == "pct" else f"printf('%.3f', {column})"


@query(
    "performance_table",
    with_(*SUM, select=" UNION ALL ".join(
        f"SELECT '{label}' AS metric, {_shown_sql(c, kind)} AS value FROM summary WHERE scenario_id = 'baseline'" for label, c, kind in reports.SUMMARY_ROWS)),
)
def performance_table(spark, sf):
    return reports.performance_table(summary(spark, sf))


@query("cost_curves", with_(RETURNS, CURVES, select=f"SELECT scenario_id, rebalance_date, {r('(wealth - 1) * 100')} AS cumulative_pct FROM curves WHERE scenario_id IN ('baseline', 'cost_frictionless', 'cost_low', 'cost_high')"))
def cost_curves(spark, sf):
    return tidy(reports.cost_curves(returns(spark, sf)))


@query("sensitivity_bars", with_(*SUM, select=f"SELECT scenario_id, {r('sharpe_ratio')} AS sharpe_ratio, {r('alpha * 100')} AS alpha_pct FROM summary WHERE starts_with(scenario_id, 'sens_')"))
def sensitivity_bars(spark, sf):
    return tidy(reports.sensitivity_bars(summary(spark, sf)))


@query(
    "exclusion_bars",
    with_(*SUM, select=f"SELECT CAST(position AS BIGINT) AS position, scenario_id, label, {r('sharpe_ratio')} AS sharpe_ratio, {r('alpha * 100')} AS alpha_pct FROM summary JOIN {_label_sql(reports.EXCLUSION_LABELS)} ON scenario_id = id"),
)
def exclusion_bars(spark, sf):
    return tidy(reports.exclusion_bars(summary(spark, sf)))


def _compare_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, {r(f'a.{m}')} AS value_a, {r(f'b.{m}')} AS value_b, {r(f'a.{m} - b.{m}')} AS diff,
  CASE WHEN (a.{m} - b.{m} > 0) = {str(up).lower()} THEN 'A' ELSE 'B' END AS winner
  FROM summary a, summary b WHERE a.scenario_id = 'baseline' AND b.scenario_id = 'cost_high'""" for m, up in reports.COMPARED)


@query("scenario_compare", with_(*SUM, select=_compare_sql()))
def scenario_compare(spark, sf):
    return tidy(reports.compare_scenarios(summary(spark, sf), "baseline", "cost_high"))


@query(
    "scenario_list",
    with_(RETURNS, select="""SELECT CAST(CASE WHEN scenario_id = 'baseline' THEN 1 WHEN starts_with(scenario_id, 'cost_') THEN 2 WHEN starts_with(scenario_id, 'excl_') THEN 3
  WHEN starts_with(scenario_id, 'sens_') THEN 4 ELSE 5 END AS INTEGER) AS "group", scenario_id,
  CASE scenario_id WHEN 'baseline' THEN 'Baseline (default parameters)' WHEN 'cost_frictionless' THEN 'Cost: Frictionless (0 bps)'
  WHEN 'cost_high' THEN 'Cost: High (50 bps)' WHEN 'excl_value' THEN 'Exclude Value factor'
  WHEN 'sens_sel_0.05' THEN 'Sensitivity: selection threshold = 0.05' END AS label FROM (SELECT DISTINCT scenario_id FROM returns)"""),
)
def scenario_list(spark, sf):
    return reports.scenario_list(returns(spark, sf).select("scenario_id").distinct())


@query("metric_ranking", with_(*SUM, select=f"SELECT scenario_id, {r('sharpe_ratio')} AS value FROM summary"))
def metric_ranking(spark, sf):
    return tidy(reports.metric_ranking(summary(spark, sf), "sharpe_ratio"))


@query(
    "parameter_effects",
    with_(*SUM, select=f"""SELECT parameter, CAST(v AS DOUBLE) + 0.0 AS value, s.scenario_id, {r('s.sharpe_ratio')} AS sharpe_ratio, {r('s.annualised_return')} AS annualised_return,
  {r('s.sharpe_ratio - b.sharpe_ratio')} AS sharpe_ratio_change, {r('s.annualised_return - b.annualised_return')} AS annualised_return_change
  FROM (VALUES ('selection_threshold', 0.05, 'sens_sel_0.05'), ('cost_bps', 0.0, 'cost_frictionless'), ('cost_bps', 50.0, 'cost_high'),
    ('selection_threshold', 0.1, 'baseline'), ('ic_lookback_months', 36.0, 'baseline'), ('ewma_lambda', 0.94, 'baseline'),
    ('no_trade_threshold', 0.01, 'baseline'), ('buffer_exit_threshold', 0.2, 'baseline'), ('cost_bps', 25.0, 'baseline')) t(parameter, v, id)
  JOIN summary s ON s.scenario_id = id, summary b WHERE b.scenario_id = 'baseline'"""),
)
def parameter_effects(spark, sf):
    return tidy(reports.against_baseline(settle(summary(spark, sf)), parameter_map(spark)))


@query("returns_between", with_(RETURNS, select=f"SELECT scenario_id, rebalance_date, {r('net_return')} AS net_return FROM returns WHERE rebalance_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"))
def returns_between(spark, sf):
    out = reports.returns_between(returns(spark, sf), "1997-01-01", "1998-12-31")
    return tidy(out.select("scenario_id", "rebalance_date", "net_return"))


@query("cumulative_return", with_(RETURNS, CURVES, select=f"SELECT scenario_id, rebalance_date, {r('wealth - 1')} AS cumulative_return FROM curves"))
def cumulative_return(spark, sf):
    return tidy(cumulative(returns(spark, sf)).select("scenario_id", "rebalance_date", "cumulative_return"))


@query(
    "display_formats",
    """SELECT o_orderkey, printf('%.2f%%', v * 100) AS pct, CASE WHEN v > 0 THEN '+' ELSE '' END || printf('%.3f', v) AS signed,
  CASE WHEN o_totalprice >= 1e6 THEN printf('%.1fM', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN printf('%.1fK', o_totalprice / 1e3)
    ELSE printf('%.0f', o_totalprice) END AS compact, strftime(o_orderdate, '%b %Y') AS month
  FROM (SELECT * EXCLUDE (o_totalprice), o_totalprice * 1.000137::DOUBLE AS o_totalprice, sin(o_orderkey) AS v FROM orders) WHERE o_totalprice >= 1""",
)
def display_formats(spark, sf):
    orders = panels.table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice") * 1.000137)
    o = orders.where("o_totalprice >= 1").withColumn("v", F.sin("o_orderkey"))
    return o.select(
        "o_orderkey", text.percent("v").alias("pct"), text.number("v", signed=True).alias("signed"),
        text.compact("o_totalprice").alias("compact"), text.month_text("o_orderdate").alias("month"),
    )
