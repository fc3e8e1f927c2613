"""Queries on cross-sections, information coefficients and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.registry import (
    CALENDAR, MONTH_PANEL, PRICES, SCORES, UNIVERSE, month_no, query, r, tidy, with_,
)
from crosstide.functions.dates import rebalance_calendar
from crosstide.operators import crosssection, ic
from crosstide.operators.crosssection import FACTOR_PARTS, LOWER_IS_BETTER, METRICS
from crosstide.operators.ranking import rank_pct
from crosstide.plans import panels, reports, strategy
from crosstide.plans.scenarios import Rules
from crosstide.session import materialize

MIN_PAIRS = 30


def per(template: str, names=METRICS, sep: str = ", ") -> str:
    return sep.join(template.replace("$", n) for n in names)


WINSOR = f"""bounds AS (SELECT sector, calc_date, {per('quantile_cont($, 0.05) AS lo_$, quantile_cont($, 0.95) AS hi_$, count($) AS n_$')}
  FROM month_panel GROUP BY 1, 2),
wins AS (SELECT p.symbol, p.sector, p.calc_date,
  {per('CASE WHEN n_$ >= 5 AND p.$ IS NOT NULL THEN least(greatest(p.$, lo_$), hi_$) ELSE p.$ END AS $')}
  FROM month_panel p JOIN bounds b ON p.sector = b.sector AND p.calc_date = b.calc_date)"""

ZSCORE = (
    f"stats AS (SELECT sector, calc_date, {per('avg($) AS mu_$, stddev_samp($) AS sd_$, count($) AS n_$')} FROM wins GROUP BY 1, 2),\n"
    "zs AS (SELECT w.*, "
    + ", ".join(
        f"CASE WHEN n_{m} < 5 THEN NULL WHEN sd_{m} < 1e-12 THEN 0.0 ELSE (w.{m} - mu_{m}) / sd_{m}"
        f"{' * -1.0' if m in LOWER_IS_BETTER else ''} END AS z_{m}"
        for m in METRICS
    )
    + " FROM wins w JOIN stats s ON w.sector = s.sector AND w.calc_date = s.calc_date)"
)


def _mean_sql(parts) -> str:
    total = " + ".join(f"coalesce(z_{m}, 0)" for m in parts)
    count = " + ".join(f"CASE WHEN z_{m} IS NULL THEN 0 ELSE 1 END" for m in parts)
    return f"({total}) / nullif({count}, 0)"


FACTORS = "fs AS (SELECT symbol, sector, calc_date, " + ", ".join(
    f"{_mean_sql(parts)} AS {f}" for f, parts in FACTOR_PARTS.items()
) + " FROM zs)"

ORTHO = f"""line AS (SELECT calc_date, count(*) AS n, regr_slope(lowvol_raw, momentum_score) AS b, regr_intercept(lowvol_raw, momentum_score) AS a
  FROM fs WHERE lowvol_raw IS NOT NULL AND momentum_score IS NOT NULL GROUP BY 1 HAVING count(*) >= {MIN_PAIRS}),
res AS (SELECT f.*, lowvol_raw - (a + b * momentum_score) AS e FROM fs f LEFT JOIN line l ON f.calc_date = l.calc_date),
ortho AS (SELECT r.*, CASE WHEN sd > 0 THEN (e - mu) / sd ELSE e END AS lowvol_score FROM res r
  JOIN (SELECT calc_date, avg(e) AS mu, stddev_samp(e) AS sd FROM res GROUP BY 1) s ON r.calc_date = s.calc_date)"""

BASE = (UNIVERSE, MONTH_PANEL)


def kept_panel(spark, sf):
    """The month panel, written once because the normalisation reads it several times."""
    return materialize(panels.month_panel(spark, sf), "month-panel")


def scored_panel(spark, sf):
    return crosssection.factor_scores(crosssection.sector_zscores(crosssection.winsorise(kept_panel(spark, sf))))


@query("winsorise", with_(*BASE, WINSOR, select="SELECT symbol, sector, calc_date, " + ", ".join(f"{r(m)} AS {m}" for m in METRICS[1:]) + f", {r('ln(pb_ratio)')} AS log_pb FROM wins"))
def winsorise(spark, sf):
    clipped = crosssection.winsorise(kept_panel(spark, sf))
    return tidy(clipped.withColumn("log_pb", F.log("pb_ratio")).drop("pb_ratio"))


@query(
    "sector_zscore",
    with_(*BASE, WINSOR, ZSCORE, select="SELECT symbol, sector, calc_date, " + ", ".join(f"{r('z_' + m)} AS z_{m}" for m in METRICS) + " FROM zs"),
)
def sector_zscore(spark, sf):
    z = crosssection.sector_zscores(crosssection.winsorise(kept_panel(spark, sf)))
    return tidy(z.drop(*METRICS))


@query(
    "factor_scores",
    with_(*BASE, WINSOR, ZSCORE, FACTORS, select="SELECT symbol, calc_date, " + ", ".join(f"{r(f)} AS {f}" for f in FACTOR_PARTS) + " FROM fs"),
)
def factor_scores(spark, sf):
    return tidy(scored_panel(spark, sf).select("symbol", "calc_date", *FACTOR_PARTS))


@query("orthogonalise", with_(*BASE, WINSOR, ZSCORE, FACTORS, ORTHO, select=f"SELECT symbol, calc_date, {r('lowvol_score')} AS lowvol_score FROM ortho"))
def orthogonalise(spark, sf):
    out = crosssection.orthogonalise(scored_panel(spark, sf), min_pairs=MIN_PAIRS)
    return tidy(out.select("symbol", "calc_date", "lowvol_score"))


@query(
    "rank_pct_sector",
    with_(
        *BASE,
        select=f"""SELECT symbol, sector, calc_date, CASE WHEN leverage IS NOT NULL THEN {r('''(rank() OVER (PARTITION BY sector, calc_date ORDER BY leverage NULLS LAST)
  + (count(*) OVER (PARTITION BY sector, calc_date, leverage) - 1) / 2.0) / count(leverage) OVER (PARTITION BY sector, calc_date)''')} END AS rank_pct
  FROM month_panel""",
    ),
)
def rank_pct_sector(spark, sf):
    p = panels.month_panel(spark, sf).select("symbol", "sector", "calc_date", "leverage")
    return tidy(rank_pct(p, ["sector", "calc_date"], "leverage", "rank_pct").drop("leverage"))


@query(
    "metric_null_counts",
    with_(*BASE, select=f"SELECT calc_date, count(*) AS rows, {per('count(*) - count($) AS null_$')} FROM month_panel GROUP BY 1"),
)
def metric_null_counts(spark, sf):
    return crosssection.null_counts(panels.month_panel(spark, sf))


# --- information coefficients -----------------------------------------------------------------

PAIRS = f"""rets AS (
  SELECT symbol, {month_no('m')} - 1 AS month, c / lag(c) OVER (PARTITION BY symbol ORDER BY m) - 1 AS ret
  FROM (SELECT symbol, date_trunc('month', trade_date) AS m, arg_max(adjusted_close, trade_date) AS c
        FROM prices GROUP BY 1, 2) QUALIFY ret IS NOT NULL),
long_scores AS (
  SELECT symbol, {month_no('score_date')} AS month, unnest(['value', 'quality', 'momentum', 'low_vol']) AS factor_name,
         unnest([z_value, z_quality, z_momentum, z_low_vol]) AS score FROM scores),
pairs AS (SELECT s.month, factor_name, score, ret FROM long_scores s JOIN rets r ON s.symbol = r.symbol AND s.month = r.month
  WHERE score IS NOT NULL)"""


def ranked_ic_sql(source: str, by: str, out: str) -> str:
    return f"""{out}_r AS (SELECT {by},
  rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {by} ORDER BY ret) + (count(*) OVER (PARTITION BY {by}, ret) - 1) / 2.0 AS ry FROM {source}),
{out} AS (SELECT {by}, count(*) AS n_pairs, CASE WHEN stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN corr(rx, ry) END AS ic_value
  FROM {out}_r GROUP BY {by} HAVING count(*) >= 10)"""


@query(
    "spearman_ic",
    with_(PRICES, *BASE, SCORES, PAIRS, ranked_ic_sql("pairs", "month, factor_name", "ics"),
          select=f"SELECT CAST(month AS INTEGER) AS month, factor_name, n_pairs, {r('ic_value')} AS ic_value FROM ics"),
)
def spearman_ic(spark, sf):
    return tidy(ic.monthly_ic(panels.month_scores(spark, sf), panels.prices(spark, sf)))


LOOKBACKS = (12, 24)
# Brute force: every window of every date, as the definition says it.
IC_WINDOWS = f"""wins AS (SELECT d, lb, CAST(d - to_months(CAST(lb + 1 AS INTEGER)) AS DATE) AS start FROM cal, (SELECT unnest({list(LOOKBACKS)}) AS lb)),
wclose AS (SELECT d, lb, symbol, date_trunc('month', trade_date) AS m, arg_max(adjusted_close, trade_date) AS c
  FROM wins JOIN prices ON trade_date < d AND trade_date >= start GROUP BY 1, 2, 3, 4),
wret AS (SELECT d, lb, symbol, {month_no('m')} - 1 AS month, c / lag(c) OVER (PARTITION BY d, lb, symbol ORDER BY m) - 1 AS ret
  FROM wclose QUALIFY ret IS NOT NULL),
long_scores AS (
  SELECT symbol, score_date, {month_no('score_date')} AS month, unnest(['value', 'quality', 'momentum', 'low_vol']) AS factor_name,
         unnest([z_value, z_quality, z_momentum, z_low_vol]) AS score FROM scores),
wpairs AS (SELECT w.d, w.lb, s.month, factor_name, score, ret FROM wins w
  JOIN long_scores s ON s.score_date < w.d AND s.score_date >= w.start
  JOIN wret r ON r.d = w.d AND r.lb = w.lb AND r.symbol = s.symbol AND r.month = s.month WHERE score IS NOT NULL),
{ranked_ic_sql('wpairs', 'd, lb, month, factor_name', 'wics')}"""


def ic_inputs(spark, sf):
    prices = materialize(panels.prices(spark, sf), "prices")
    return materialize(panels.month_scores(spark, sf), "month-scores"), prices, rebalance_calendar(prices)


@query(
    "ic_as_of",
    with_(PRICES, CALENDAR, *BASE, SCORES, IC_WINDOWS,
          select=f"""SELECT d AS rebalance_date, CAST(lb AS INTEGER) AS ic_lookback_months, CAST(month AS INTEGER) AS month, factor_name,
  {r('ic_value')} AS ic_value FROM wics"""),
)
def ic_as_of(spark, sf):
    return tidy(ic.ic_as_of(*ic_inputs(spark, sf), LOOKBACKS))


WEIGHTS = """runs AS (SELECT * FROM (VALUES ('baseline', 24, NULL), ('short', 12, NULL), ('excl_quality', 24, 'quality')) t(scenario_id, lb, excl)),
months AS (SELECT d, lb, count(DISTINCT month) AS n FROM wics GROUP BY 1, 2),
means AS (SELECT d, lb, factor_name, avg(ic_value) AS ic FROM wics GROUP BY 1, 2, 3),
grid AS (SELECT scenario_id, c.d, runs.lb, excl, f AS factor_name FROM cal c, runs, (SELECT unnest(['value', 'quality', 'momentum', 'low_vol']) AS f)
  WHERE c.d > (SELECT min(score_date) FROM scores)),
raw AS (SELECT g.*, CASE WHEN coalesce(n, 0) >= 12 THEN coalesce(ic, 0) ELSE 0 END AS ic_mean,
    CASE WHEN excl IS NULL OR excl <> g.factor_name THEN 1.0 ELSE 0.0 END AS used FROM grid g
  LEFT JOIN months m ON g.d = m.d AND g.lb = m.lb LEFT JOIN means x ON g.d = x.d AND g.lb = x.lb AND g.factor_name = x.factor_name),
tot AS (SELECT *, greatest(ic_mean, 0) * used AS fl, sum(greatest(ic_mean, 0) * used) OVER w AS total, sum(used) OVER w AS n_used
  FROM raw WINDOW w AS (PARTITION BY scenario_id, d)),
weights AS (SELECT scenario_id, d AS rebalance_date, factor_name, ic_mean AS ic_mean_36m,
  CASE WHEN total > 0 THEN fl / total ELSE used / n_used END AS ic_weight FROM tot)"""

RUNS = [
    Rules(ic_lookback_months=24),
    Rules("short", ic_lookback_months=12),
    Rules("excl_quality", ic_lookback_months=24, excluded_factor="quality"),
]


@query(
    "ic_weights",
    with_(PRICES, CALENDAR, *BASE, SCORES, IC_WINDOWS, WEIGHTS,
          select=f"SELECT scenario_id, rebalance_date, factor_name, {r('ic_mean_36m')} AS ic_mean_36m, {r('ic_weight')} AS ic_weight FROM weights"),
)
def ic_weights(spark, sf):
    scores, prices, calendar = ic_inputs(spark, sf)
    weights, _ = strategy.ic_and_composite(scores, prices, calendar, RUNS, 12)
    return tidy(weights)


COMPOSITE = """wide_w AS (SELECT scenario_id, rebalance_date, max(ic_weight) FILTER (factor_name = 'value') AS wv,
    max(ic_weight) FILTER (factor_name = 'quality') AS wq, max(ic_weight) FILTER (factor_name = 'momentum') AS wm,
    max(ic_weight) FILTER (factor_name = 'low_vol') AS wl,
    (SELECT max(score_date) FROM scores s WHERE s.score_date < w.rebalance_date) AS score_date
  FROM weights w GROUP BY 1, 2),
comp AS (SELECT scenario_id, rebalance_date, s.score_date, symbol,
  wv * z_value + wq * z_quality + wm * z_momentum + wl * z_low_vol AS composite_score
  FROM wide_w w JOIN scores s ON s.score_date = w.score_date)"""


@query(
    "composite_score",
    with_(PRICES, CALENDAR, *BASE, SCORES, IC_WINDOWS, WEIGHTS, COMPOSITE,
          select=f"SELECT scenario_id, rebalance_date, score_date, symbol, {r('composite_score')} AS composite_score FROM comp"),
)
def composite_score(spark, sf):
    scores, prices, calendar = ic_inputs(spark, sf)
    _, composite = strategy.ic_and_composite(scores, prices, calendar, RUNS, 12)
    return tidy(composite)


# --- distributions ---------------------------------------------------------------------------------

Z = ("z_value", "z_quality", "z_momentum", "z_low_vol")
EQUAL = """eq AS (SELECT s.symbol, u.sector, score_date, (z_value + z_quality + z_momentum + z_low_vol) / 4 AS composite_score
  FROM scores s JOIN universe u ON s.symbol = u.symbol)"""


def equal_composite(spark, sf):
    s = panels.month_scores(spark, sf)
    total = (F.col("z_value") + F.col("z_quality") + F.col("z_momentum") + F.col("z_low_vol")) / 4
    return s.join(panels.universe(spark, sf).select("symbol", "sector"), "symbol").select(
        "symbol", "sector", "score_date", total.alias("composite_score")
    )


@query(
    "factor_correlation",
    with_(*BASE, SCORES,
          select=" UNION ALL ".join(
              f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, {r(f'corr({a}, {b})')} AS correlation FROM scores WHERE "
              + " AND ".join(f"{z} IS NOT NULL" for z in Z) for a in Z for b in Z)),
)
def factor_correlation(spark, sf):
    return tidy(reports.correlation_matrix(panels.month_scores(spark, sf)))


@query(
    "composite_histogram",
    with_(*BASE, SCORES, EQUAL,
          """span AS (SELECT score_date, min(composite_score) AS lo, max(composite_score) AS hi FROM eq WHERE composite_score IS NOT NULL GROUP BY 1)""",
          select=f"""SELECT e.score_date, CAST(least(floor((composite_score - lo) / ((hi - lo) / 15)), 14) AS INTEGER) AS bin,
  {r('min(lo + (hi - lo) / 15 * least(floor((composite_score - lo) / ((hi - lo) / 15)), 14))')} AS bin_start, count(*) AS n
  FROM eq e JOIN span s ON e.score_date = s.score_date WHERE composite_score IS NOT NULL GROUP BY 1, 2"""),
)
def composite_histogram(spark, sf):
    return tidy(reports.histogram(equal_composite(spark, sf), "composite_score", 15, ["score_date"]))


@query(
    "composite_summary",
    with_(*BASE, SCORES, EQUAL,
          select=f"""SELECT score_date, count(composite_score) AS n, {r('min(composite_score)')} AS min, {r('max(composite_score)')} AS max,
  {r('quantile_cont(composite_score, 0.1)')} AS p10, {r('quantile_cont(composite_score, 0.5)')} AS median, {r('quantile_cont(composite_score, 0.9)')} AS p90
  FROM eq GROUP BY 1 HAVING count(composite_score) > 0"""),
)
def composite_summary(spark, sf):
    return tidy(reports.distribution(equal_composite(spark, sf), "composite_score", ["score_date"]))


@query(
    "zscore_boxplot",
    with_(*BASE, SCORES,
          select=f"""SELECT sector, score_date, count(z_value) AS n, {r('min(z_value)')} AS min, {r('quantile_cont(z_value, 0.25)')} AS q1,
  {r('quantile_cont(z_value, 0.5)')} AS median, {r('quantile_cont(z_value, 0.75)')} AS q3, {r('max(z_value)')} AS max, {r('avg(z_value)')} AS mean
  FROM scores s JOIN universe u ON s.symbol = u.symbol GROUP BY 1, 2"""),
)
def zscore_boxplot(spark, sf):
    scores = panels.month_scores(spark, sf).join(panels.universe(spark, sf).select("symbol", "sector"), "symbol")
    return tidy(reports.box_stats(scores, "z_value", ["sector", "score_date"]))
