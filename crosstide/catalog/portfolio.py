"""Queries on selection, positions and the backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.cross import EQUAL, equal_composite
from crosstide.catalog.registry import (
    BENCHMARK, CALENDAR, MONTH_PANEL, PRICES, SCORES, UNIVERSE, query, r, tidy, with_,
)
from crosstide.catalog.series import ASOF
from crosstide.operators import backtest, positions, selection, timeline
from crosstide.plans import panels, reports
from crosstide.plans.scenarios import Rules, cost_table, rules_table
from crosstide.session import materialize, settle

BASE = (UNIVERSE, MONTH_PANEL)

# --- selection -------------------------------------------------------------------------------

RULE_ROWS = [Rules(), Rules("sens_buffer_0.25", buffer_exit_threshold=0.25), Rules("sens_sel_0.20", selection_threshold=0.20, buffer_exit_threshold=0.35)]
RULES_SQL = """rules AS (SELECT * FROM (VALUES ('baseline', 0.1::DOUBLE, 0.2::DOUBLE, 3), ('sens_buffer_0.25', 0.1::DOUBLE, 0.25::DOUBLE, 3),
  ('sens_sel_0.20', 0.2::DOUBLE, 0.35::DOUBLE, 3)) t(scenario_id, s, b, patience))"""
RANKED = """ranked AS (SELECT scenario_id, s, b, patience, symbol, sector, score_date AS d, composite_score,
  dense_rank() OVER (PARTITION BY scenario_id ORDER BY score_date) AS ord,
  (rank() OVER (PARTITION BY scenario_id, sector, score_date ORDER BY composite_score)
    + (count(*) OVER (PARTITION BY scenario_id, sector, score_date, composite_score) - 1) / 2.0)
    / count(*) OVER (PARTITION BY scenario_id, sector, score_date) AS pct
  FROM eq, rules WHERE composite_score IS NOT NULL)"""


def _zone() -> str:
    return """CASE WHEN r.pct >= 1.0::DOUBLE - r.s THEN 'top' WHEN r.pct >= 1.0::DOUBLE - r.b THEN 'upper' WHEN r.pct <= r.s THEN 'bottom'
    WHEN r.pct <= r.b THEN 'lower' ELSE 'middle' END"""


# First row of a run of consecutive dates starts without a past; later rows follow the row before.
STATE = f"""zoned AS (SELECT *, {_zone()} AS zone FROM ranked r),
st AS (
  SELECT z.scenario_id, z.symbol, z.ord,
    CASE zone WHEN 'top' THEN 'long_core' WHEN 'bottom' THEN 'short_core' ELSE 'not_selected' END AS status,
    0 AS buf, CASE WHEN zone IN ('top', 'bottom') THEN z.d END AS entry, CAST(NULL AS VARCHAR) AS reason
  FROM zoned z WHERE NOT EXISTS (SELECT 1 FROM zoned y WHERE y.scenario_id = z.scenario_id AND y.symbol = z.symbol AND y.ord = z.ord - 1)
  UNION ALL
  SELECT scenario_id, symbol, ord, status,
    CASE WHEN status LIKE '%buffer' THEN buf + 1 ELSE 0 END,
    CASE WHEN status = 'not_selected' THEN NULL WHEN left(status, 4) = left(was, 4) THEN entry ELSE d END,
    CASE WHEN status = 'not_selected' THEN CASE WHEN in_buffer THEN 'timer_exit' WHEN was <> 'not_selected' THEN 'hard_stop' END END
  FROM (SELECT z.scenario_id, z.symbol, z.ord, z.d, p.status AS was, p.buf, p.entry,
      (zone = 'upper' AND p.status LIKE 'long%') OR (zone = 'lower' AND p.status LIKE 'short%') AS in_buffer,
      CASE WHEN zone = 'top' THEN 'long_core' WHEN zone = 'bottom' THEN 'short_core'
        WHEN zone = 'upper' AND p.status LIKE 'long%' AND p.buf + 1 < z.patience THEN 'long_buffer'
        WHEN zone = 'lower' AND p.status LIKE 'short%' AND p.buf + 1 < z.patience THEN 'short_buffer'
        ELSE 'not_selected' END AS status
    FROM st p JOIN zoned z ON z.scenario_id = p.scenario_id AND z.symbol = p.symbol AND z.ord = p.ord + 1)),
sel AS (SELECT s.scenario_id, s.symbol, z.d AS rebalance_date, z.sector, z.composite_score, z.pct AS percentile_rank, s.status,
    s.buf AS buffer_months_count, s.entry AS entry_date, s.reason AS exit_reason
  FROM st s JOIN zoned z ON s.scenario_id = z.scenario_id AND s.symbol = z.symbol AND s.ord = z.ord)"""

SELECT_CTE = (*BASE, SCORES, EQUAL, RULES_SQL, RANKED, STATE)


def selection_table(spark, sf):
    runs = F.array(*[F.lit(x.scenario_id) for x in RULE_ROWS])
    composite = equal_composite(spark, sf).select(
        "symbol", F.col("score_date").alias("rebalance_date"), "composite_score", F.explode(runs).alias("scenario_id")
    )
    ranked = selection.sector_ranks(composite, panels.universe(spark, sf))
    return selection.select_names(ranked, rules_table(spark, RULE_ROWS))


@query(
    "selection_state",
    with_(*SELECT_CTE, recursive=True, select=f"""SELECT scenario_id, symbol, rebalance_date, sector, {r('composite_score')} AS composite_score,
  {r('percentile_rank')} AS percentile_rank, status, CAST(buffer_months_count AS INTEGER) AS buffer_months_count, entry_date, exit_reason FROM sel"""),
)
def selection_state(spark, sf):
    return tidy(selection_table(spark, sf).drop("ord"))


@query(
    "status_counts",
    with_(*SELECT_CTE, recursive=True, select="SELECT scenario_id, rebalance_date, "
          + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in selection.STATUSES)
          + """, count(*) FILTER (entry_date = rebalance_date AND status LIKE 'long%') AS new_long,
  count(*) FILTER (entry_date = rebalance_date AND status LIKE 'short%') AS new_short, count(exit_reason) AS exits,
  count(*) FILTER (exit_reason IS NOT NULL AND was LIKE 'long%') AS long_exits, count(*) FILTER (exit_reason IS NOT NULL AND was LIKE 'short%') AS short_exits,
  count(*) FILTER (exit_reason = 'timer_exit') AS timer_exits, count(*) FILTER (exit_reason = 'hard_stop') AS hard_stops
  FROM (SELECT *, lag(status) OVER (PARTITION BY scenario_id, symbol ORDER BY rebalance_date) AS was FROM sel) GROUP BY 1, 2"""),
)
def status_counts(spark, sf):
    return selection.status_changes(selection_table(spark, sf))


@query(
    "stock_card",
    with_(*SELECT_CTE, recursive=True, select=f"""SELECT scenario_id, symbol, {r('arg_max(composite_score, rebalance_date)')} AS latest_composite,
  count(*) FILTER (status LIKE 'long%') AS months_long, count(*) FILTER (status LIKE 'short%') AS months_short FROM sel GROUP BY 1, 2"""),
)
def stock_card(spark, sf):
    return tidy(reports.stock_card(selection_table(spark, sf)))


@query(
    "selection_markers",
    with_(PRICES, *SELECT_CTE, recursive=True, select=f"""SELECT scenario_id, e.symbol, e.rebalance_date, status, p.trade_date AS asof_trade_date,
  {r('ln(p.adjusted_close)')} AS log_close
  FROM (SELECT * FROM sel WHERE exit_reason IS NOT NULL OR entry_date = rebalance_date) e
  ASOF LEFT JOIN prices p ON e.symbol = p.symbol AND e.rebalance_date >= p.trade_date"""),
)
def selection_markers(spark, sf):
    changed = selection_table(spark, sf).where("exit_reason is not null or entry_date = rebalance_date")
    events = changed.select("scenario_id", "symbol", "rebalance_date", "status")
    marked = reports.price_markers(events, panels.prices(spark, sf))
    return tidy(marked.withColumn("log_close", F.log("adjusted_close")).drop("adjusted_close"))


# --- positions -------------------------------------------------------------------------------

BOOK = """book AS (SELECT 'baseline' AS scenario_id, calc_date AS rebalance_date, symbol, sector,
  CASE WHEN momentum_6m >= 0.04 THEN 'long' ELSE 'short' END AS direction, coalesce(leverage, 0.04::DOUBLE) / 10 AS target_weight,
  pb_ratio * volatility_12m AS adv_20d, pb_ratio AS composite_score, volatility_12m AS ewma_vol
  FROM month_panel)"""


def book(spark, sf):
    return panels.month_positions(spark, sf)


@query(
    "risk_adjusted",
    with_(*BASE, BOOK, select=f"""SELECT scenario_id, rebalance_date, symbol, direction,
  {r("CASE WHEN direction = 'long' THEN target_weight - 0.005 ELSE abs(target_weight - 0.005) END / (ewma_vol)")} AS risk_adj_score
  FROM book WHERE ewma_vol > 20"""),
)
def risk_adjusted(spark, sf):
    """Scores over volatility; names without a volatility (here: 20 or less) drop out."""
    held = book(spark, sf).withColumn("composite_score", F.col("target_weight") - 0.005)
    known = F.when(F.col("volatility_12m") > 20, F.col("volatility_12m"))
    vols = panels.month_panel(spark, sf).select("symbol", "calc_date", F.lit(0.94).alias("ewma_lambda"), known.alias("ewma_vol"))
    out = positions.risk_adjusted(held, vols, rules_table(spark, [Rules()]))
    return tidy(out.select("scenario_id", "rebalance_date", "symbol", "direction", "risk_adj_score"))


WEIGHTED = """weighted AS (SELECT b.*, CASE WHEN tot > 0 THEN risk_adj_score / tot ELSE 1.0 / names END
    * CASE direction WHEN 'long' THEN 1.3 ELSE 0.3 END / k AS w
  FROM (SELECT *, sum(risk_adj_score) OVER (PARTITION BY rebalance_date, sector, direction) AS tot,
      count(*) OVER (PARTITION BY rebalance_date, sector, direction) AS names
    FROM (SELECT *, target_weight - 0.005 AS risk_adj_score FROM book)) b
  JOIN (SELECT rebalance_date AS d, direction AS dir, count(DISTINCT sector) AS k FROM book GROUP BY 1, 2) k
  ON b.rebalance_date = k.d AND b.direction = k.dir)"""


@query("sector_weights", with_(*BASE, BOOK, WEIGHTED, select=f"SELECT scenario_id, rebalance_date, symbol, sector, direction, {r('w')} AS target_weight FROM weighted"))
def sector_weights(spark, sf):
    scored = book(spark, sf).withColumn("risk_adj_score", F.col("target_weight") - 0.005).drop("target_weight")
    out = positions.sector_weights(scored)
    return tidy(out.select("scenario_id", "rebalance_date", "symbol", "sector", "direction", "target_weight"))


# Cap = 5 % of traded value over a book of 15 M: binds for many names.
AUM = 15_000_000.0


def _round_sql(k: int) -> str:
    return f"""r{k} AS (SELECT * EXCLUDE (w, capped, ex, op), capped OR w > cap AS capped,
  CASE WHEN w > cap THEN cap WHEN w < cap AND ex IS NOT NULL AND op > 0 THEN w * (1 + ex / op) ELSE w END AS w
  FROM (SELECT *, sum(w - cap) FILTER (w > cap) OVER g AS ex, sum(w) FILTER (w < cap) OVER g AS op
    FROM r{k - 1} WINDOW g AS (PARTITION BY rebalance_date, sector, direction)))"""


CAPPED = (
    f"r0 AS (SELECT *, target_weight AS w, false AS capped, CASE WHEN adv_20d > 0 THEN 0.05::DOUBLE / {AUM}::DOUBLE * adv_20d ELSE 'inf'::DOUBLE END AS cap FROM book),\n"
    + ",\n".join(_round_sql(k) for k in range(1, positions.MAX_ROUNDS + 1))
    + ",\ncapped AS (SELECT * FROM r10)"
)


def capped_book(spark, sf):
    b = materialize(book(spark, sf), "book")
    adv = b.select("symbol", "rebalance_date", "adv_20d")
    rules = rules_table(spark, [Rules(aum=AUM)])
    return positions.liquidity_cap(b.drop("adv_20d"), adv, rules)


@query(
    "liquidity_cap",
    with_(*BASE, BOOK, CAPPED, select=f"SELECT scenario_id, rebalance_date, symbol, sector, direction, {r('w')} AS target_weight, capped AS liquidity_capped FROM capped"),
)
def liquidity_cap(spark, sf):
    return tidy(capped_book(spark, sf).select(
        "scenario_id", "rebalance_date", "symbol", "sector", "direction", "target_weight", "liquidity_capped"
    ))


NO_TRADE = """targets AS (SELECT *, dense_rank() OVER (ORDER BY rebalance_date) AS ord FROM book),
nt AS (
  SELECT symbol, sector, direction, ord, rebalance_date, target_weight, target_weight AS final_weight, 'trade' AS trade_action FROM targets WHERE ord = 1
  UNION ALL
  SELECT symbol, sector, direction, ord, rebalance_date, target_weight,
    CASE WHEN held THEN pw ELSE (sum(target_weight) OVER g - coalesce(sum(pw) FILTER (held) OVER g, 0))
      * CASE WHEN sum(target_weight) FILTER (NOT held) OVER g > 0 THEN target_weight / sum(target_weight) FILTER (NOT held) OVER g
             ELSE 1.0 / count(*) FILTER (NOT held) OVER g END END,
    CASE WHEN held THEN 'hold' ELSE 'trade' END
  FROM (SELECT t.*, p.final_weight AS pw, coalesce(p.direction = t.direction AND abs(t.target_weight - p.final_weight) < 0.002::DOUBLE, false) AS held
    FROM targets t JOIN (SELECT max(ord) AS o FROM nt) x ON t.ord = x.o + 1 LEFT JOIN nt p ON p.symbol = t.symbol)
  WINDOW g AS (PARTITION BY sector, direction))"""


def traded_book(spark, sf):
    rules = rules_table(spark, [Rules(no_trade_threshold=0.002)])
    return positions.no_trade_zone(book(spark, sf), rules)


@query(
    "no_trade_sector_move",
    with_(*BASE, """book AS (SELECT 'baseline' AS scenario_id, calc_date AS rebalance_date, symbol, CASE WHEN month(calc_date) % 2 = 0 THEN sector ELSE 'MOVED ' || left(sector, 2) END AS sector,
    CASE WHEN momentum_6m >= 0.04 THEN 'long' ELSE 'short' END AS direction, coalesce(leverage, 0.04::DOUBLE) / 10 AS target_weight FROM month_panel)""",
          NO_TRADE, recursive=True, select=f"SELECT rebalance_date, symbol, sector, direction, {r('final_weight')} AS final_weight, trade_action FROM nt"),
)
def no_trade_sector_move(spark, sf):
    """Names change their sector between dates; what they held goes with them."""
    moved = F.when(F.month("rebalance_date") % 2 == 0, F.col("sector")).otherwise(F.concat(F.lit("MOVED "), F.left("sector", F.lit(2))))
    rules = rules_table(spark, [Rules(no_trade_threshold=0.002)])
    out = positions.no_trade_zone(book(spark, sf).drop("adv_20d").withColumn("sector", moved), rules)
    return tidy(out.select("rebalance_date", "symbol", "sector", "direction", "final_weight", "trade_action"))


@query(
    "no_trade_zone",
    with_(*BASE, BOOK, NO_TRADE, recursive=True, select=f"SELECT rebalance_date, symbol, sector, direction, {r('target_weight')} AS target_weight, {r('final_weight')} AS final_weight, trade_action FROM nt"),
)
def no_trade_zone(spark, sf):
    return tidy(traded_book(spark, sf).select(
        "rebalance_date", "symbol", "sector", "direction", "target_weight", "final_weight", "trade_action"
    ))


FINAL = "pos AS (SELECT *, target_weight AS final_weight FROM book)"


def plain_positions(spark, sf):
    return book(spark, sf).withColumn("final_weight", F.col("target_weight"))


EXPOSURE = """expo AS (SELECT scenario_id, rebalance_date, coalesce(sum(final_weight) FILTER (direction = 'long'), 0) AS l,
  coalesce(sum(final_weight) FILTER (direction = 'short'), 0) AS s FROM pos GROUP BY 1, 2)"""


@query(
    "constraint_check",
    with_(*BASE, BOOK, """pos AS (SELECT *, target_weight / sum(target_weight) OVER (PARTITION BY rebalance_date, direction)
    * CASE direction WHEN 'long' THEN 1.3 + 0.012::DOUBLE * (month(rebalance_date) % 4) ELSE 0.3 + 0.009::DOUBLE * (month(rebalance_date) % 5) END AS final_weight FROM book)""",
          EXPOSURE, select=f"""SELECT scenario_id, rebalance_date, {r('l')} AS long_exposure, {r('s')} AS short_exposure, {r('l - s')} AS net_exposure,
  abs(l - 1.3) <= 0.02 AS long_ok, abs(s - 0.3) <= 0.02 AS short_ok, abs(l - s - 1) <= 0.02 AS net_ok,
  abs(l - 1.3) <= 0.02 AND abs(s - 0.3) <= 0.02 AND abs(l - s - 1) <= 0.02 AS passed FROM expo"""),
)
def constraint_check(spark, sf):
    """Both budgets are met on some dates and missed by little on others."""
    held = book(spark, sf)
    sums = held.groupBy("rebalance_date", "direction").agg(F.sum("target_weight").alias("total"))
    month = F.month("rebalance_date")
    budget = F.when(F.col("direction") == "long", 1.3 + 0.012 * (month % 4)).otherwise(0.3 + 0.009 * (month % 5))
    scaled = held.join(sums, ["rebalance_date", "direction"]).withColumn("final_weight", F.col("target_weight") / F.col("total") * budget)
    return tidy(positions.constraint_check(scaled))


# --- backtest ---------------------------------------------------------------------------------

HELD = """pdates AS (SELECT rebalance_date AS d, lead(rebalance_date) OVER (ORDER BY rebalance_date) AS nd,
    row_number() OVER (ORDER BY rebalance_date) - 1 AS ord FROM (SELECT DISTINCT rebalance_date FROM pos)),
ret AS (SELECT p.*, nd, ord, b.price / a.price - 1 AS rr
  FROM pos p JOIN pdates t ON p.rebalance_date = t.d
  LEFT JOIN held a ON a.symbol = p.symbol AND a.calc_date = p.rebalance_date
  LEFT JOIN held b ON b.symbol = p.symbol AND b.calc_date = t.nd)"""
BACKTEST = (PRICES, CALENDAR, *BASE, BOOK, FINAL, ASOF, HELD)


def returned(spark, sf):
    prices = timeline.month_end_prices(panels.prices(spark, sf), panels.last_month_end(spark, sf))
    return backtest.holding_returns(plain_positions(spark, sf), prices)


@query("stock_returns", with_(*BACKTEST, select=f"SELECT symbol, rebalance_date, nd AS next_date, {r('rr')} AS stock_return FROM ret"))
def stock_returns(spark, sf):
    return tidy(returned(spark, sf).select("symbol", "rebalance_date", "next_date", "stock_return"))


def _totals_sql(drift: str) -> str:
    return f"""totals AS (SELECT coalesce(c.ord, p.ord + 1) AS ord, max(c.nd) AS nd,
  sum(CASE WHEN c.direction = 'long' THEN coalesce(c.final_weight * c.rr, 0) ELSE 0 END) AS long_return,
  sum(CASE WHEN c.direction = 'short' THEN coalesce(c.final_weight * c.rr, 0) ELSE 0 END) AS short_return,
  sum(CASE WHEN c.direction = 'short' THEN c.final_weight ELSE 0 END) AS short_notional,
  CASE WHEN coalesce(c.ord, p.ord + 1) = 0 THEN 0 ELSE sum(CASE WHEN c.direction <> p.direction
    THEN p.final_weight * (1 + coalesce({drift}, 0)) + c.final_weight
    ELSE abs(coalesce(c.final_weight, 0) - coalesce(p.final_weight * (1 + coalesce({drift}, 0)), 0)) END) END AS turnover
  FROM ret c FULL JOIN ret p ON p.symbol = c.symbol AND p.ord + 1 = c.ord GROUP BY 1 HAVING max(c.nd) IS NOT NULL)"""


@query(
    "turnover",
    with_(*BACKTEST, _totals_sql("c.rr"), select=f"""SELECT nd AS rebalance_date, {r('long_return')} AS long_return, {r('short_return')} AS short_return,
  {r('long_return - short_return')} AS gross_return, {r('turnover')} AS turnover, {r('short_notional')} AS short_notional FROM totals"""),
)
def turnover(spark, sf):
    out = backtest.period_totals(returned(spark, sf))
    return tidy(out.select("rebalance_date", "long_return", "short_return", "gross_return", "turnover", "short_notional"))


@query("turnover_realised", with_(*BACKTEST, _totals_sql("p.rr"), select=f"SELECT nd AS rebalance_date, {r('turnover')} AS turnover FROM totals"))
def turnover_realised(spark, sf):
    out = backtest.period_totals(returned(spark, sf), "realised")
    return tidy(out.select("rebalance_date", "turnover"))


COSTED = """costs AS (SELECT * FROM (VALUES ('baseline', 25.0::DOUBLE, 0.0075::DOUBLE), ('cost_frictionless', 0.0, 0.0), ('cost_low', 10.0, 0.0075), ('cost_high', 50.0, 0.0075)) t(scenario_id, bps, borrow)),
costed AS (SELECT scenario_id, nd AS rebalance_date, long_return - short_return AS gross_return, long_return, short_return, turnover,
  turnover * bps / 10000 + short_notional * borrow / 12 AS transaction_cost,
  long_return - short_return - (turnover * bps / 10000 + short_notional * borrow / 12) AS net_return, monthly_return AS benchmark_return
  FROM totals, costs LEFT JOIN bench ON date_trunc('month', month_end) = date_trunc('month', nd))"""


@query(
    "cost_scenarios",
    with_(*BACKTEST, _totals_sql("c.rr"), BENCHMARK, COSTED, select="SELECT scenario_id, rebalance_date, "
          + ", ".join(f"{r(c)} AS {c}" for c in ("gross_return", "long_return", "short_return", "turnover", "transaction_cost", "net_return", "benchmark_return"))
          + f", {r('net_return - benchmark_return')} AS excess_return FROM costed"),
)
def cost_scenarios(spark, sf):
    totals = settle(backtest.period_totals(returned(spark, sf)))
    out = backtest.with_costs(totals, cost_table(spark, [Rules()]), panels.benchmark(spark, sf))
    return tidy(out.drop("cumulative_return"))


# --- portfolio tables -------------------------------------------------------------------------

BOOK_BASE = (*BASE, BOOK, FINAL)


@query(
    "holdings_at_date",
    with_(*BOOK_BASE, select=f"""SELECT rebalance_date, p.symbol, p.sector, direction, {r('final_weight')} AS final_weight, security
  FROM pos p LEFT JOIN universe u ON p.symbol = u.symbol WHERE rebalance_date = (SELECT max(rebalance_date) FROM pos WHERE rebalance_date <= DATE '1998-06-30')"""),
)
def holdings_at_date(spark, sf):
    out = reports.holdings(plain_positions(spark, sf), panels.universe(spark, sf), "1998-06-30")
    return tidy(out.select("rebalance_date", "symbol", "sector", "direction", "final_weight", "security"))


@query(
    "sector_breakdown",
    with_(*BOOK_BASE, select=f"""SELECT scenario_id, rebalance_date, sector, count(*) FILTER (direction = 'long') AS long_names, count(*) FILTER (direction = 'short') AS short_names,
  {r("coalesce(sum(final_weight) FILTER (direction = 'long'), 0)")} AS long_weight, {r("coalesce(sum(final_weight) FILTER (direction = 'short'), 0)")} AS short_weight,
  {r("sum(CASE direction WHEN 'long' THEN final_weight ELSE -final_weight END)")} AS net_weight FROM pos GROUP BY 1, 2, 3"""),
)
def sector_breakdown(spark, sf):
    return tidy(reports.sector_breakdown(plain_positions(spark, sf)))


@query(
    "sector_exposure_grid",
    with_(*BOOK_BASE, select=f"""SELECT d.scenario_id, s.sector, d.rebalance_date, {r("coalesce(sum(CASE direction WHEN 'long' THEN final_weight ELSE -final_weight END) * 100, 0)")} AS exposure_pct
  FROM (SELECT DISTINCT scenario_id, rebalance_date FROM pos) d CROSS JOIN (SELECT DISTINCT sector FROM pos) s
  LEFT JOIN pos p ON p.rebalance_date = d.rebalance_date AND p.sector = s.sector GROUP BY 1, 2, 3"""),
)
def sector_exposure_grid(spark, sf):
    return tidy(reports.exposure_heatmap(plain_positions(spark, sf)))


@query(
    "latest_portfolio",
    with_(*BOOK_BASE, EXPOSURE, select=f"""SELECT scenario_id, rebalance_date, (SELECT count(DISTINCT symbol) FROM pos p WHERE p.rebalance_date = e.rebalance_date) AS names,
  {r('l')} AS long_exposure, {r('s')} AS short_exposure, {r('l - s')} AS net_exposure FROM expo e WHERE rebalance_date = (SELECT max(rebalance_date) FROM pos)"""),
)
def latest_portfolio(spark, sf):
    return tidy(reports.latest_portfolio(plain_positions(spark, sf)))
