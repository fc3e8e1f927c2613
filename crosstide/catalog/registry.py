"""Registered queries: a Spark callable and, where SQL can say it, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosstide.functions.numeric import rounded
from crosstide.plans.panels import bme_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def tidy(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round every double column the way the check SQL does."""
    places = digits if isinstance(digits, dict) else {}
    default = 6 if isinstance(digits, dict) else digits
    return df.select(
        *[
            rounded(f.name, places.get(f.name, default)).alias(f.name) if f.dataType.simpleString() == "double" else f.name
            for f in df.schema.fields
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def with_(*fragments: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(fragments) + "\n" + select


# --- shared panels as SQL (same definitions as crosstide.plans.panels) -----------------

PRICES = """prices AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         sum(round(l_extendedprice * 100)) / 100 / sum(l_quantity) AS adjusted_close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

PRICES_NATION = """prices AS (
  SELECT n_name AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         sum(round(l_extendedprice * 100)) / 100 / sum(l_quantity) AS adjusted_close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)"""

UNIVERSE = """universe AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS security, r_name AS sector, n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FILINGS = """filings AS (
  SELECT symbol, fiscal_year, fiscal_quarter,
         CAST(last_day(make_date(fiscal_year, fiscal_quarter * 3, 1)) AS DATE) AS report_date,
         total_assets, total_debt, net_income, total_assets - total_debt AS book_equity,
         shares_outstanding, net_income / shares_outstanding AS eps
  FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS symbol,
           CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(quarter(l_shipdate) AS INTEGER) AS fiscal_quarter,
           sum(round(l_extendedprice * 100)) / 100 AS total_assets,
           sum(round(l_extendedprice * 100) * round(l_discount * 100)) / 10000 AS total_debt,
           sum(round(l_extendedprice * 100) * (2 * round(l_tax * 100) - round(l_discount * 100))) / 20000 AS net_income,
           CAST(sum(l_quantity) AS BIGINT) AS shares_outstanding
    FROM lineitem GROUP BY 1, 2, 3))"""

MONTH_PANEL = f"""month_raw AS (
  SELECT symbol, {bme_sql("trade_date")} AS calc_date,
         sum(v) / 100 / sum(q) AS pb_ratio,
         (max(v) - min(v)) / min(v) AS asset_growth,
         CASE WHEN count(*) FILTER (flag = 'R') > 0 THEN sum(v * (2 * t - d)) / 200 / sum(v) END AS roe,
         CASE WHEN sum(q) >= 40 THEN sum(v * d) / 100 / sum(v) END AS leverage,
         CASE WHEN count(*) > 1 THEN sqrt((sum(q * q) - sum(q) * sum(q) / count(*)) / (count(*) - 1)) END AS earnings_stability,
         sum(v * t) / 100 / sum(v) AS momentum_6m,
         sum(q * t) / 100 / sum(q) AS momentum_12m,
         CASE WHEN count(*) > 1 THEN sqrt((sum(v * v) - sum(v) * sum(v) / count(*)) / (count(*) - 1)) / (sum(v) / count(*)) END
           AS volatility_3m,
         sum(q) / count(*) AS volatility_12m
  FROM (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_quantity AS q,
               l_returnflag AS flag, round(l_extendedprice * 100) AS v, round(l_discount * 100) AS d,
               round(l_tax * 100) AS t FROM lineitem) GROUP BY 1, 2),
month_panel AS (SELECT m.symbol, sector, m.* EXCLUDE (symbol) FROM month_raw m JOIN universe u ON m.symbol = u.symbol)"""

SCORES = """scores AS (
  SELECT symbol, calc_date AS score_date, -ln(pb_ratio) AS z_value, roe AS z_quality,
         momentum_6m - momentum_12m AS z_momentum, -volatility_12m / 10 AS z_low_vol
  FROM month_panel)"""

BENCHMARK = """bench AS (
  SELECT month_end, c / lag(c) OVER (ORDER BY month_end) - 1 AS monthly_return
  FROM (SELECT CAST(last_day(d) AS DATE) AS month_end, arg_max(p, d) AS c
        FROM (SELECT CAST(l_shipdate AS DATE) AS d, sum(round(l_extendedprice * 100)) / 100 / sum(l_quantity) AS p
              FROM lineitem GROUP BY 1) GROUP BY 1) QUALIFY monthly_return IS NOT NULL)"""

RATES = """rates AS (
  SELECT n_name AS country, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS rate_date,
         sum(round(l_tax * 100)) / count(*) / 100 AS rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""

CALENDAR = f"""cal AS (
  SELECT {bme_sql("CAST(m AS DATE)")} AS d, lo, hi
  FROM (SELECT lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m
        FROM (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM prices))
  QUALIFY d BETWEEN lo AND hi)""".replace("QUALIFY d BETWEEN lo AND hi", "WHERE " + bme_sql("CAST(m AS DATE)") + " BETWEEN lo AND hi")


def bme_before_sql(day: str, k: int) -> str:
    """k-th business month end strictly before a date expression."""
    here = bme_sql(day)
    shifted = lambda n: bme_sql(f"CAST(date_trunc('month', {day}) - INTERVAL {n} MONTH AS DATE)")
    return f"(CASE WHEN {here} < {day} THEN {shifted(k - 1)} ELSE {shifted(k)} END)"


def month_no(day: str) -> str:
    return f"(year({day}) * 12 + month({day}))"
