"""Stored stages brought up to date after late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.cross import FACTORS, MIN_PAIRS, ORTHO, WINSOR, ZSCORE
from crosstide.catalog.registry import BENCHMARK, MONTH_PANEL, UNIVERSE, query, r, tidy, with_
from crosstide.catalog.storage import store
from crosstide.operators import crosssection
from crosstide.operators.crosssection import METRICS
from crosstide.plans import panels
from crosstide.plans.stages import Read, Source, Stage, run_stages, stored_rows
from crosstide.session import materialize


def _zscores(inputs):
    panel = inputs["factor_metrics"].join(inputs["universe"].select("symbol", "sector"), "symbol")
    return crosssection.sector_zscores(crosssection.winsorise(materialize(panel, "stage-panel")))


def _scores(inputs):
    scored = crosssection.orthogonalise(crosssection.factor_scores(inputs["factor_zscores"]), min_pairs=MIN_PAIRS)
    return scored.withColumnRenamed("calc_date", "score_date").select(
        "symbol", "score_date", F.col("value_score").alias("z_value"), F.col("quality_score").alias("z_quality"),
        F.col("momentum_score").alias("z_momentum"), F.col("lowvol_score").alias("z_low_vol"),
    )


STAGES = (
    Stage("factor_metrics", (Read("trades"), Read("universe")), lambda x: panels.month_metrics(x["trades"], x["universe"])),
    Stage("factor_zscores", (Read("factor_metrics"), Read("universe")), _zscores, "winsorise 0.05 0.95"),
    Stage("factor_scores", (Read("factor_zscores"),), _scores, f"orthogonalise {MIN_PAIRS}"),
    Stage("benchmark_returns", (Read("trades", back=1),), lambda x: panels.index_returns(x["trades"])),
)
LATE = "1996-03"


def _per_month(table: str, date: str, column: str, rows: str, reach: int) -> str:
    touched = f"year({date}) * 12 + month({date}) BETWEEN 1996 * 12 + 3 AND 1996 * 12 + 3 + {reach}"
    return f"""SELECT '{table}' AS table_name, strftime({date}, '%Y-%m') AS month, count(*) AS rows, {r(f'sum({column})', 4)} AS total, bool_or({touched}) AS computed
  FROM {rows} GROUP BY 2"""


@query(
    "backfill_dates",
    with_(
        UNIVERSE, MONTH_PANEL, WINSOR, ZSCORE, FACTORS, ORTHO, BENCHMARK,
        select=" UNION ALL ".join(
            (
                _per_month("factor_metrics", "calc_date", METRICS[1], "month_panel", 0),
                _per_month("factor_zscores", "calc_date", f"z_{METRICS[1]}", "zs", 0),
                _per_month("factor_scores", "calc_date", "lowvol_score", "ortho", 0),
                _per_month("benchmark_returns", "month_end", "monthly_return", "bench", 1),
            )
        ),
    ),
)
def backfill_dates(spark, sf):
    """All months are stored without some trades of one month, which then come in late.

    The second run computes that month of each stage, and the next month too
    where a stage looks one month back; the tables are those of a run over all rows.
    """
    place, trades, names = store(spark), materialize(panels.trades(spark, sf), "trades"), panels.universe(spark, sf)
    month = F.date_format("trade_date", "yyyy-MM")
    months = [x[0] for x in trades.select(month).distinct().collect()]

    def run(rows):
        sources = {"trades": Source(rows, "trade_date"), "universe": Source(names)}
        return run_stages(spark, place, sources, STAGES, months)

    run(trades.where((month != LATE) | (F.col("l_suppkey") % 3 != 0)))
    again = set(run(trades))
    if run(trades):
        raise RuntimeError("a run over the same rows computed something")
    parts = {
        "factor_metrics": ("calc_date", METRICS[1]), "factor_zscores": ("calc_date", f"z_{METRICS[1]}"),
        "factor_scores": ("score_date", "z_low_vol"), "benchmark_returns": ("month_end", "monthly_return"),
    }
    out = None
    for table, (date, column) in parts.items():
        name = F.date_format(date, "yyyy-MM")
        computed = name.isin([m for t, m in again if t == table])
        one = stored_rows(spark, place, table).groupBy(F.lit(table).alias("table_name"), name.alias("month"))
        one = one.agg(F.count(F.lit(1)).alias("rows"), F.sum(column).alias("total"), F.bool_or(computed).alias("computed"))
        out = one if out is None else out.unionByName(one)
    return tidy(out, 4)
