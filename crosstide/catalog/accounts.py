"""Queries on filings: point-in-time ratios, merging and conforming."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.registry import (
    CALENDAR, FILINGS, PRICES, PRICES_NATION, RATES, bme_before_sql, query, r, tidy, with_,
)
from crosstide.catalog.series import ASOF, MOMENTUM, SHORT_RATES
from crosstide.functions.dates import rebalance_calendar
from crosstide.operators import fundamentals, merging, timeline
from crosstide.plans import panels, strategy
from crosstide.session import materialize

LATEST = """latest AS (
  SELECT s.symbol, s.d AS calc_date, f.* EXCLUDE (symbol)
  FROM (SELECT DISTINCT symbol, d FROM filings, cal) s
  ASOF JOIN (SELECT *, lag(book_equity) OVER w AS prior_equity, lag(report_date) OVER w AS prior_report_date
             FROM filings WINDOW w AS (PARTITION BY symbol ORDER BY report_date)) f
  ON s.symbol = f.symbol AND s.d - 45 >= f.report_date),
prior AS (
  SELECT l.*, p.total_assets AS prior_year_assets FROM latest l LEFT JOIN filings p
  ON p.symbol = l.symbol AND p.fiscal_year = l.fiscal_year - 1 AND p.fiscal_quarter = l.fiscal_quarter
  AND p.report_date <= l.calc_date - 45),
ratios AS (
  SELECT symbol, calc_date, book_equity, shares_outstanding,
    (total_assets - prior_year_assets) / abs(nullif(prior_year_assets, 0)) AS asset_growth,
    CASE WHEN report_date >= calc_date - 590 THEN net_income / nullif(greatest(
      CASE WHEN prior_report_date >= calc_date - 590 THEN (book_equity + prior_equity) / 2 ELSE book_equity END, 0), 0) END AS roe,
    CASE WHEN book_equity > 0 THEN total_debt / book_equity END AS leverage
  FROM prior)"""

STABILITY = """annual AS (
  SELECT symbol, d AS calc_date, fiscal_year, sum(eps) AS eps FROM filings JOIN cal
  ON report_date <= d - 45 AND report_date >= d - 45 - 1915 GROUP BY 1, 2, 3),
growths AS (
  SELECT symbol, calc_date, CASE WHEN fiscal_year - lag(fiscal_year) OVER w = 1 AND abs(lag(eps) OVER w) >= 0.01
    THEN least(greatest((eps - lag(eps) OVER w) / abs(lag(eps) OVER w), -5.0), 5.0) END AS g
  FROM annual WINDOW w AS (PARTITION BY symbol, calc_date ORDER BY fiscal_year)),
stability AS (SELECT symbol, calc_date, CASE WHEN count(g) >= 5 THEN stddev_samp(g) END AS earnings_stability
  FROM growths GROUP BY 1, 2)"""

BASE = (PRICES, CALENDAR, FILINGS, LATEST)


def latest(spark, sf):
    filings = panels.fundamentals(spark, sf)
    return fundamentals.latest_filing(filings, panels.last_month_end(spark, sf)), filings


@query("latest_filing", with_(*BASE, select=f"SELECT symbol, calc_date, report_date, fiscal_year, fiscal_quarter, {r('total_assets', 2)} AS total_assets FROM latest"))
def latest_filing(spark, sf):
    panel, _ = latest(spark, sf)
    return tidy(panel.select("symbol", "calc_date", "report_date", "fiscal_year", "fiscal_quarter", "total_assets"), 2)


@query("prior_year_join", with_(*BASE, select=f"SELECT symbol, calc_date, fiscal_year, fiscal_quarter, {r('prior_year_assets', 2)} AS prior_year_assets FROM prior"))
def prior_year_join(spark, sf):
    out = fundamentals.prior_year_filing(*latest(spark, sf))
    return tidy(out.select("symbol", "calc_date", "fiscal_year", "fiscal_quarter", "prior_year_assets"), 2)


def _ratio_query(name):
    @query(name, with_(*BASE, select=f"SELECT symbol, calc_date, {r(name)} AS {name} FROM ratios"))
    def one(spark, sf):
        ratios = fundamentals.accounting_ratios(fundamentals.prior_year_filing(*latest(spark, sf)))
        return tidy(ratios.select("symbol", "calc_date", name))

    return one


for _name in ("asset_growth", "roe", "leverage"):
    _ratio_query(_name)


@query(
    "pb_ratio",
    with_(*BASE, ASOF, select=f"""SELECT x.symbol, x.calc_date, {r('ln(price / (book_equity / shares_outstanding))')} AS log_pb
  FROM ratios x LEFT JOIN held h ON x.symbol = h.symbol AND x.calc_date = h.calc_date"""),
)
def pb_ratio(spark, sf):
    ratios = fundamentals.accounting_ratios(fundamentals.prior_year_filing(*latest(spark, sf)))
    prices = timeline.month_end_prices(panels.prices(spark, sf), panels.last_month_end(spark, sf))
    out = fundamentals.price_to_book(ratios, prices)
    return tidy(out.select("symbol", "calc_date", F.log("pb_ratio").alias("log_pb")))


@query("earnings_stability", with_(PRICES, CALENDAR, FILINGS, STABILITY, select=f"SELECT symbol, calc_date, {r('earnings_stability')} AS earnings_stability FROM stability"))
def earnings_stability(spark, sf):
    out = fundamentals.earnings_stability(panels.fundamentals(spark, sf), panels.last_month_end(spark, sf))
    return tidy(out)


VOLATILITY = f"""vwin AS (
  SELECT c.d AS calc_date, p.symbol, p.trade_date,
         ln(p.adjusted_close / lag(p.adjusted_close) OVER (PARTITION BY c.d, p.symbol ORDER BY p.trade_date)) AS ret
  FROM cal c JOIN prices p ON p.trade_date <= c.d AND p.trade_date >= {bme_before_sql('c.d', 16)}),
vnum AS (SELECT *, row_number() OVER (PARTITION BY calc_date, symbol ORDER BY ret IS NULL, trade_date DESC) AS rn FROM vwin),
vols AS (SELECT symbol, calc_date,
  CASE WHEN count(ret) FILTER (rn <= 63) >= 50 THEN stddev_samp(ret) FILTER (rn <= 63) * sqrt(252) END AS volatility_3m,
  CASE WHEN count(ret) FILTER (rn <= 252) >= 200 THEN stddev_samp(ret) FILTER (rn <= 252) * sqrt(252) END AS volatility_12m
  FROM vnum GROUP BY 1, 2)"""


@query(
    "nine_metric_panel",
    with_(
        *BASE, STABILITY, RATES, SHORT_RATES, ASOF, MOMENTUM, VOLATILITY,
        f"""keys AS (SELECT symbol, calc_date FROM ratios UNION SELECT symbol, calc_date FROM stability
  UNION SELECT symbol, calc_date FROM mom UNION SELECT symbol, calc_date FROM vols)""",
        select=f"""SELECT k.symbol, k.calc_date,
  {r(f"ln(CASE WHEN price_date >= {bme_before_sql('k.calc_date', 16)} THEN price END / (book_equity / shares_outstanding))")} AS log_pb,
  {r('asset_growth')} AS asset_growth, {r('roe')} AS roe, {r('leverage')} AS leverage,
  {r('earnings_stability')} AS earnings_stability, {r('momentum_6m')} AS momentum_6m, {r('momentum_12m')} AS momentum_12m,
  {r('volatility_3m')} AS volatility_3m, {r('volatility_12m')} AS volatility_12m
  FROM keys k LEFT JOIN ratios a ON k.symbol = a.symbol AND k.calc_date = a.calc_date
  LEFT JOIN held h ON k.symbol = h.symbol AND k.calc_date = h.calc_date
  LEFT JOIN stability s ON k.symbol = s.symbol AND k.calc_date = s.calc_date
  LEFT JOIN mom m ON k.symbol = m.symbol AND k.calc_date = m.calc_date
  LEFT JOIN vols v ON k.symbol = v.symbol AND k.calc_date = v.calc_date""",
    ),
)
def nine_metric_panel(spark, sf):
    prices = materialize(panels.prices(spark, sf), "prices")
    out = strategy.metric_panel(
        prices, materialize(panels.fundamentals(spark, sf), "filings"), panels.rates(spark, sf), rebalance_calendar(prices),
        panels.last_month_end(spark, sf), "NATION_3",
    )
    return tidy(out.withColumn("log_pb", F.log("pb_ratio")).drop("pb_ratio"))


# --- merging -------------------------------------------------------------------------------------

# Three sources with holes: the first lacks some fields and quarters, the
# second has shifted values, the third is complete.
SOURCED = """sourced AS (
  SELECT symbol, fiscal_year, fiscal_quarter, report_date, 1 AS priority, 'edgar' AS source,
    total_assets, CASE WHEN fiscal_quarter <> 2 OR CAST(symbol AS BIGINT) % 3 = 0 THEN total_debt END AS total_debt,
    CASE WHEN fiscal_year <> 1997 OR CAST(symbol AS BIGINT) % 3 = 0 THEN net_income END AS net_income,
    book_equity, shares_outstanding, eps FROM filings WHERE fiscal_year <> 1999 OR fiscal_quarter <> 3
  UNION ALL
  SELECT symbol, fiscal_year, fiscal_quarter, report_date, 2, 'simfin', total_assets + 1, total_debt + 1,
    CASE WHEN CAST(symbol AS BIGINT) % 3 = 1 OR fiscal_year <> 1997 THEN net_income + 1 END, book_equity + 1, shares_outstanding + 1, eps + 1
    FROM filings WHERE fiscal_year >= 1996
  UNION ALL
  SELECT symbol, fiscal_year, fiscal_quarter, report_date, 3, 'yfinance', total_assets + 2, total_debt + 2,
    net_income + 2, book_equity + 2, shares_outstanding + 2, eps + 2 FROM filings)"""


def sourced(spark, sf):
    f = panels.fundamentals(spark, sf)
    third = F.col("symbol").cast("bigint") % 3
    columns = ["total_assets", "total_debt", "net_income", "book_equity", "shares_outstanding", "eps"]

    def source(priority, name):
        shifted = [(F.col(c) + (priority - 1)).alias(c) for c in columns]
        return f.select(
            "symbol", "fiscal_year", "fiscal_quarter", "report_date",
            F.lit(priority).alias("priority"), F.lit(name).alias("source"), *shifted,
        )

    first = (
        source(1, "edgar")
        .where("fiscal_year <> 1999 or fiscal_quarter <> 3")
        .withColumn("total_debt", F.when((F.col("fiscal_quarter") != 2) | (third == 0), F.col("total_debt")))
        .withColumn("net_income", F.when((F.col("fiscal_year") != 1997) | (third == 0), F.col("net_income")))
    )
    second = (
        source(2, "simfin")
        .where("fiscal_year >= 1996")
        .withColumn("net_income", F.when((third == 1) | (F.col("fiscal_year") != 1997), F.col("net_income")))
    )
    return first.unionByName(second).unionByName(source(3, "yfinance"))


FIELDS = ("total_assets", "total_debt", "net_income", "book_equity", "shares_outstanding", "eps")
MERGE = (
    "fieldwise AS (SELECT symbol, fiscal_year, fiscal_quarter, arg_min(source, priority) AS source, "
    + ", ".join(f"arg_min({c}, priority) FILTER ({c} IS NOT NULL) AS {c}" for c in FIELDS)
    + " FROM $ GROUP BY 1, 2, 3)"
)
HAS_NULL = " OR ".join(f"{c} IS NULL" for c in FIELDS)
# A lower source is used only while the symbol's merged rows so far have a gap.
LADDER = f"""p1 AS (SELECT * FROM sourced WHERE priority = 1),
open1 AS (SELECT DISTINCT symbol FROM p1 WHERE {HAS_NULL}),
p2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM sourced WHERE priority = 2 AND symbol IN (FROM open1)),
m2 AS (SELECT symbol, fiscal_year, fiscal_quarter, {", ".join(f"max({c}) AS {c}" for c in FIELDS)} FROM p2 GROUP BY 1, 2, 3),
open2 AS (SELECT DISTINCT symbol FROM m2 WHERE {HAS_NULL}),
used AS (SELECT * FROM p2 UNION ALL SELECT * FROM sourced WHERE priority = 3 AND symbol IN (FROM open2) AND symbol IN (FROM open1))"""
SHOWN = "symbol, fiscal_year, fiscal_quarter, source, " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c == "shares_outstanding" else f"{r(c)} AS {c}" for c in FIELDS
)


def _shown(df):
    return tidy(df.select("symbol", "fiscal_year", "fiscal_quarter", "source", *FIELDS))


@query("waterfall_merge", with_(FILINGS, SOURCED, MERGE.replace("$", "sourced"), select=f"SELECT {SHOWN} FROM fieldwise"))
def waterfall_merge(spark, sf):
    return _shown(merging.waterfall_merge(sourced(spark, sf), early_exit=False))


@query("waterfall_early_exit", with_(FILINGS, SOURCED, LADDER, MERGE.replace("$", "used"), select=f"SELECT {SHOWN} FROM fieldwise"))
def waterfall_early_exit(spark, sf):
    return _shown(merging.waterfall_merge(sourced(spark, sf)))


GAPS = """gaps AS (SELECT symbol, fiscal_year, fiscal_quarter, CASE WHEN hole THEN NULL ELSE total_assets END AS total_assets,
  CASE WHEN hole OR fiscal_quarter = 3 THEN NULL ELSE eps END AS eps, 'edgar' AS source
  FROM (SELECT *, (CAST(symbol AS BIGINT) + fiscal_year * 4 + fiscal_quarter) % 7 < 4 AS hole FROM filings))"""
FILLED = """filled AS (SELECT symbol, fiscal_year, fiscal_quarter,
  coalesce(total_assets, lag(total_assets, 1) OVER w, lag(total_assets, 2) OVER w) AS total_assets,
  coalesce(eps, lag(eps, 1) OVER w, lag(eps, 2) OVER w) AS eps,
  total_assets IS NULL AND eps IS NULL AS blank, source
  FROM gaps WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year, fiscal_quarter))"""


def gaps(spark, sf):
    f = panels.fundamentals(spark, sf)
    hole = (F.col("symbol").cast("bigint") + F.col("fiscal_year") * 4 + F.col("fiscal_quarter")) % 7 < 4
    return f.select(
        "symbol", "fiscal_year", "fiscal_quarter",
        F.when(~hole, F.col("total_assets")).alias("total_assets"),
        F.when(~hole & (F.col("fiscal_quarter") != 3), F.col("eps")).alias("eps"),
        F.lit("edgar").alias("source"),
    )


@query(
    "bounded_ffill",
    with_(FILINGS, GAPS, FILLED, select=f"""SELECT symbol, fiscal_year, fiscal_quarter, {r('total_assets', 3)} AS total_assets, {r('eps')} AS eps,
  CASE WHEN blank AND (total_assets IS NOT NULL OR eps IS NOT NULL) THEN 'ffill' ELSE source END AS source FROM filled"""),
)
def bounded_ffill(spark, sf):
    return tidy(merging.bounded_fill(gaps(spark, sf), 2, ("total_assets", "eps")), {"total_assets": 3})


@query(
    "ytd_decumulate",
    with_(FILINGS, GAPS, select=f"""SELECT symbol, fiscal_year, fiscal_quarter,
  {r('eps - coalesce(lag(eps) OVER (PARTITION BY symbol, fiscal_year ORDER BY fiscal_quarter), 0)')} AS eps FROM gaps"""),
)
def ytd_decumulate(spark, sf):
    out = merging.standalone_quarters(gaps(spark, sf), ("eps",))
    return tidy(out.select("symbol", "fiscal_year", "fiscal_quarter", "eps"))


@query(
    "last_n_quarters",
    with_(FILINGS, select="""SELECT symbol, fiscal_year, fiscal_quarter, report_date FROM filings
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC, fiscal_quarter DESC) <= 12"""),
)
def last_n_quarters(spark, sf):
    out = merging.last_quarters(panels.fundamentals(spark, sf), "3y")
    return out.select("symbol", "fiscal_year", "fiscal_quarter", "report_date")
