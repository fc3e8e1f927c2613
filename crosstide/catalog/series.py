"""Queries on price series."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.registry import (
    BENCHMARK, CALENDAR, PRICES, PRICES_NATION, RATES, bme_before_sql, query, r, tidy, with_,
)
from crosstide.functions.dates import rebalance_calendar
from crosstide.operators import rolling, timeline
from crosstide.plans import panels, strategy
from crosstide.plans.scenarios import Liquidity

RETURNS = """rets AS (
  SELECT symbol, CAST(last_day(m) AS DATE) AS month_end, c / lag(c) OVER (PARTITION BY symbol ORDER BY m) - 1 AS ret
  FROM (SELECT symbol, date_trunc('month', trade_date) AS m, arg_max(adjusted_close, trade_date) AS c
        FROM prices GROUP BY 1, 2) QUALIFY ret IS NOT NULL)"""


@query("monthly_return", with_(PRICES, RETURNS, select=f"SELECT symbol, month_end, {r('ret')} AS monthly_return FROM rets"))
def monthly_return(spark, sf):
    return tidy(timeline.monthly_returns(panels.prices(spark, sf)).select("symbol", "month_end", "monthly_return"))


@query("benchmark_return", with_(BENCHMARK, select=f"SELECT month_end, {r('monthly_return')} AS monthly_return FROM bench"))
def benchmark_return(spark, sf):
    return tidy(panels.benchmark(spark, sf).select("month_end", "monthly_return"))


LIQ_WINDOW = """win AS (
  SELECT c.d AS calc_date, p.symbol, p.trade_date, p.adjusted_close * p.volume AS dv,
         abs(ln(p.adjusted_close / lag(p.adjusted_close) OVER (PARTITION BY c.d, p.symbol ORDER BY p.trade_date)))
           / (p.adjusted_close * p.volume) AS impact,
         row_number() OVER (PARTITION BY c.d, p.symbol ORDER BY p.trade_date DESC) AS rn
  FROM cal c JOIN prices p ON p.trade_date < c.d AND p.trade_date >= c.d - 42
  WHERE p.volume > 0),
adv AS (SELECT symbol, calc_date, avg(dv) AS adtv FROM win WHERE rn <= 20 GROUP BY 1, 2 HAVING count(*) = 20),
ill AS (SELECT symbol, calc_date, avg(impact) AS amihud FROM win WHERE rn <= 21 GROUP BY 1, 2 HAVING count(impact) = 21)"""


@query(
    "rolling_adtv",
    with_(PRICES_NATION, CALENDAR, LIQ_WINDOW, select=f"SELECT symbol, calc_date, {r('adtv')} AS adv_20d FROM adv"),
)
def rolling_adtv(spark, sf):
    p = panels.prices_nation(spark, sf)
    out = timeline.trailing_liquidity(p, panels.last_month_end(spark, sf)).where("adtv is not null")
    return tidy(out.select("symbol", "calc_date", F.col("adtv").alias("adv_20d")))


@query(
    "amihud_illiq",
    with_(PRICES_NATION, CALENDAR, LIQ_WINDOW, select=f"SELECT symbol, calc_date, {r('amihud * 1e6')} AS amihud_e6 FROM ill"),
)
def amihud_illiq(spark, sf):
    p = panels.prices_nation(spark, sf)
    out = timeline.trailing_liquidity(p, panels.last_month_end(spark, sf)).where("amihud_illiq is not null")
    return tidy(out.select("symbol", "calc_date", (F.col("amihud_illiq") * 1e6).alias("amihud_e6")))


@query(
    "liquidity_screen",
    with_(
        PRICES_NATION, CALENDAR, LIQ_WINDOW,
        """flag AS (
  SELECT a.symbol, a.calc_date, adtv, adtv >= 60000 AS passes_adv,
         CASE WHEN adtv >= 60000 THEN amihud END AS amihud
  FROM adv a LEFT JOIN ill i ON a.symbol = i.symbol AND a.calc_date = i.calc_date),
ranked AS (
  SELECT *, CASE WHEN amihud IS NOT NULL THEN
    (rank() OVER (PARTITION BY calc_date ORDER BY amihud NULLS LAST)
      + (count(*) OVER (PARTITION BY calc_date, amihud) - 1) / 2.0)
    / count(amihud) OVER (PARTITION BY calc_date) END AS pct FROM flag)""",
        select=f"""SELECT symbol, calc_date, {r('adtv')} AS adv_20d, {r('pct')} AS illiq_rank_pct, passes_adv,
  coalesce(pct <= 1.0 - 0.1, false) AS passes_illiq, passes_adv AND coalesce(pct <= 1.0 - 0.1, false) AS passes_filter
  FROM ranked""",
    ),
)
def liquidity_screen(spark, sf):
    p = panels.prices_nation(spark, sf)
    out = strategy.liquidity_screen(p, panels.last_month_end(spark, sf), Liquidity(adtv_min_dollar=60_000.0))
    return tidy(out.drop("amihud_illiq"))


@query(
    "volatility_3m_12m",
    with_(
        PRICES_NATION, CALENDAR,
        f"""win AS (
  SELECT c.d AS calc_date, p.symbol, p.trade_date,
         ln(p.adjusted_close / lag(p.adjusted_close) OVER (PARTITION BY c.d, p.symbol ORDER BY p.trade_date)) AS ret
  FROM cal c JOIN prices p ON p.trade_date <= c.d AND p.trade_date >= {bme_before_sql('c.d', 16)}),
num AS (SELECT *, row_number() OVER (PARTITION BY calc_date, symbol ORDER BY ret IS NULL, trade_date DESC) AS rn FROM win)""",
        select=f"""SELECT symbol, calc_date,
  {r('CASE WHEN count(ret) FILTER (rn <= 63) >= 50 THEN stddev_samp(ret) FILTER (rn <= 63) * sqrt(252) END')} AS volatility_3m,
  {r('CASE WHEN count(ret) FILTER (rn <= 252) >= 200 THEN stddev_samp(ret) FILTER (rn <= 252) * sqrt(252) END')} AS volatility_12m,
  CAST(calc_date - max(trade_date) AS INTEGER) AS price_age_days
  FROM num GROUP BY 1, 2""",
    ),
)
def volatility_3m_12m(spark, sf):
    p = panels.prices_nation(spark, sf)
    out = rolling.realised_volatility(p, panels.last_month_end(spark, sf))
    return tidy(out.select("symbol", "calc_date", "volatility_3m", "volatility_12m", "price_age_days"))


# steps of 400, so that many days repeat the price of the day before
COARSE = "coarse AS (SELECT symbol, trade_date, floor(adjusted_close / 400) * 400 + 1 AS price FROM prices)"


@query(
    "volatility_flags",
    with_(
        PRICES, CALENDAR, COARSE,
        f"""win AS (
  SELECT c.d AS calc_date, p.symbol, p.trade_date,
         ln(p.price / lag(p.price) OVER (PARTITION BY c.d, p.symbol ORDER BY p.trade_date)) AS ret
  FROM cal c JOIN coarse p ON p.trade_date <= c.d AND p.trade_date >= {bme_before_sql('c.d', 16)}),
num AS (SELECT *, row_number() OVER (PARTITION BY calc_date, symbol ORDER BY ret IS NULL, trade_date DESC) AS rn FROM win),
flags AS (
  SELECT symbol, calc_date, CAST(calc_date - max(trade_date) AS INTEGER) AS price_age_days,
    CASE WHEN count(ret) FILTER (rn <= 63) >= 50 THEN count(*) FILTER (rn <= 63 AND ret = 0) > 0.10 * count(ret) FILTER (rn <= 63) END AS volatility_3m_stale,
    CASE WHEN count(ret) FILTER (rn <= 252) >= 70 THEN count(*) FILTER (rn <= 252 AND ret = 0) > 0.10 * count(ret) FILTER (rn <= 252) END AS volatility_12m_stale
  FROM num GROUP BY 1, 2)""",
        select="""SELECT symbol, calc_date, price_age_days, price_age_days > 5 AS price_old, volatility_3m_stale, volatility_12m_stale,
  price_age_days <= 5 AND NOT coalesce(volatility_3m_stale, false) AND NOT coalesce(volatility_12m_stale, false) AS usable FROM flags""",
    ),
)
def volatility_flags(spark, sf):
    """Quality of each month end's volatility: age of the price, share of zero returns."""
    p = panels.prices(spark, sf)
    coarse = p.withColumn("adjusted_close", F.floor(F.col("adjusted_close") / 400) * 400 + F.lit(1.0))
    windows = {"volatility_3m": (63, 50), "volatility_12m": (252, 70)}
    return rolling.stale_flags(rolling.realised_volatility(coarse, panels.last_month_end(spark, sf), windows=windows))


@query(
    "ewma_vol",
    with_(
        PRICES_NATION, CALENDAR,
        """win AS (
  SELECT c.d AS calc_date, p.symbol, p.trade_date,
         ln(p.adjusted_close / lag(p.adjusted_close) OVER (PARTITION BY c.d, p.symbol ORDER BY p.trade_date)) AS ret
  FROM cal c JOIN prices p ON p.trade_date < c.d AND p.trade_date >= c.d - 312),
num AS (SELECT *, row_number() OVER (PARTITION BY calc_date, symbol ORDER BY trade_date) AS i,
          count(*) OVER (PARTITION BY calc_date, symbol) AS n FROM win WHERE ret IS NOT NULL),
lam AS (SELECT unnest([0.9::DOUBLE, 0.94::DOUBLE]) AS a)""",
        select=f"""SELECT symbol, calc_date, a AS ewma_lambda,
  {r('sqrt(252 * (pow(a, max(n) - 20) * var_samp(ret) FILTER (i <= 20) + (1 - a) * coalesce(sum(pow(a, n - i) * ret * ret) FILTER (i > 20), 0)))')} AS ewma_vol
  FROM num, lam GROUP BY 1, 2, 3 HAVING max(n) >= 20""",
    ),
)
def ewma_vol(spark, sf):
    p = panels.prices_nation(spark, sf)
    return tidy(rolling.ewma_volatility(p, panels.last_month_end(spark, sf), (0.90, 0.94)))


ASOF = """held AS (
  SELECT s.symbol, s.d AS calc_date, p.trade_date AS price_date, p.adjusted_close AS price
  FROM (SELECT DISTINCT symbol, d FROM prices, cal) s ASOF JOIN prices p ON s.symbol = p.symbol AND s.d >= p.trade_date)"""


@query(
    "asof_price",
    with_(PRICES, CALENDAR, ASOF, select=f"SELECT symbol, calc_date, price_date, {r('ln(price)')} AS log_price FROM held"),
)
def asof_price(spark, sf):
    p = panels.prices(spark, sf)
    held = timeline.month_end_prices(p, panels.last_month_end(spark, sf))
    return tidy(held.withColumn("log_price", F.log("price")).drop("price"))


@query(
    "asof_event",
    """SELECT p.event_id, p.user_id, v.event_id AS view_id, v.ts AS view_ts
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v
  ON p.user_id = v.user_id AND p.ts > v.ts""",
)
def asof_event(spark, sf):
    """Last view of the same user strictly before each purchase."""
    events = panels.table(spark, sf, "events")
    probes = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(
        F.max("event_id").alias("view_id")
    )
    found = timeline.asof_lookup(probes, views, ["user_id"], "ts", "view_ts", ["view_id"], strict=True)
    return found.select("event_id", "user_id", "view_id", F.col("asof_view_ts").alias("view_ts"))


SHORT_RATES = """short_rates AS (
  SELECT d AS calc_date, coalesce(rate, 0.0) AS rate
  FROM cal ASOF LEFT JOIN (SELECT * FROM rates WHERE country = 'NATION_3') x ON cal.d >= x.rate_date)"""


@query(
    "asof_rate",
    with_(PRICES, CALENDAR, RATES, SHORT_RATES, select=f"SELECT calc_date, {r('rate')} AS rate FROM short_rates"),
)
def asof_rate(spark, sf):
    calendar = rebalance_calendar(panels.prices(spark, sf))
    return tidy(strategy.short_rates(panels.rates(spark, sf), calendar, "NATION_3"))


MOMENTUM = (
    "mom_in AS (SELECT a.*, "
    + ", ".join(f"lag(price, {k}) OVER w AS p{k}, lag(price_date, {k}) OVER w AS d{k}" for k in (1, 7, 13))
    + f", {bme_before_sql('calc_date', 16)} AS oldest FROM held a WINDOW w AS (PARTITION BY symbol ORDER BY calc_date)),\n"
    + """mom AS (SELECT symbol, m.calc_date,
  CASE WHEN d1 >= oldest AND d7 >= oldest THEN p1 / p7 - 1 - (pow(1 + rate, 1.0 / 12) - 1) END AS momentum_6m,
  CASE WHEN d1 >= oldest AND d13 >= oldest THEN p1 / p13 - 1 - (pow(1 + rate, 1.0 / 12) - 1) END AS momentum_12m
  FROM mom_in m JOIN short_rates s ON m.calc_date = s.calc_date)"""
)


@query(
    "momentum",
    with_(
        PRICES, CALENDAR, RATES, SHORT_RATES, ASOF, MOMENTUM,
        select=f"SELECT symbol, calc_date, {r('momentum_6m')} AS momentum_6m, {r('momentum_12m')} AS momentum_12m FROM mom",
    ),
)
def momentum(spark, sf):
    p = panels.prices(spark, sf)
    rates = strategy.short_rates(panels.rates(spark, sf), rebalance_calendar(p), "NATION_3")
    return tidy(timeline.momentum(timeline.month_end_prices(p, panels.last_month_end(spark, sf)), rates))


@query(
    "rebalance_calendar",
    with_(
        PRICES, CALENDAR,
        select=f"SELECT d AS rebalance_date, {bme_before_sql('d', 1)} AS t1, {bme_before_sql('d', 7)} AS t7, "
        f"{bme_before_sql('d', 13)} AS t13 FROM cal",
    ),
)
def calendar_dates(spark, sf):
    from crosstide.functions.dates import month_end_before

    cal = rebalance_calendar(panels.prices(spark, sf))
    return cal.select("rebalance_date", *[month_end_before("rebalance_date", k).alias(f"t{k}") for k in (1, 7, 13)])
