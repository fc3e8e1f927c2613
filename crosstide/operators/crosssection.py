"""Cross-sectional normalisation inside (sector, date) groups.

Groups are never collected: statistics are grouped aggregates with map-side
partials, and come back to the rows by a join with the (small) result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.functions.numeric import clip, mean_of
from crosstide.operators.ranking import group_quantiles

# The nine metrics, the ones where lower is better, and the
# metrics that make up each factor.
METRICS = (
    "pb_ratio",
    "asset_growth",
    "roe",
    "leverage",
    "earnings_stability",
    "momentum_6m",
    "momentum_12m",
    "volatility_3m",
    "volatility_12m",
)
LOWER_IS_BETTER = ("pb_ratio", "asset_growth", "leverage", "earnings_stability", "volatility_3m", "volatility_12m")
FACTOR_PARTS = {
    "value_score": ("pb_ratio", "asset_growth"),
    "quality_score": ("roe", "leverage", "earnings_stability"),
    "momentum_score": ("momentum_6m", "momentum_12m"),
    "lowvol_raw": ("volatility_3m", "volatility_12m"),
}
MIN_GROUP = 5
MIN_PAIRS = 50
GROUP = ("sector", "calc_date")


def winsorise(
    panel: DataFrame,
    metrics: Sequence[str] = METRICS,
    lower: float = 0.05,
    upper: float = 0.95,
    by: Sequence[str] = GROUP,
) -> DataFrame:
    """Clip each metric to its group quantiles; groups under 5 values stay as they are.

    Rows without a sector become null, as they belong to no group.
    """
    wide = _metric_bounds(panel.where(F.col("sector").isNotNull()), metrics, (lower, upper), list(by))

    def clipped(m: str) -> Column:
        low, high = F.col(f"_q0_{m}"), F.col(f"_q1_{m}")
        inside = F.when(F.col(m).isNotNull() & low.isNotNull(), clip(m, low, high)).otherwise(F.col(m))
        return F.when(F.col("sector").isNotNull(), inside).alias(m)

    joined = panel.join(wide, list(by), "left")
    return joined.select(*[clipped(c) if c in metrics else F.col(c) for c in panel.columns])


def _metric_bounds(placed: DataFrame, metrics: Sequence[str], probs: tuple[float, float], by: list[str]) -> DataFrame:
    """Quantiles of every metric per group as columns ``_q0_<metric>``, ``_q1_<metric>``."""
    long = placed.unpivot(by, list(metrics), "metric", "value")
    bounds = group_quantiles(long, [*by, "metric"], "value", probs).where(F.col("n") >= MIN_GROUP)
    return bounds.groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"_{q}_{m}") for m in metrics for q in ("q0", "q1")]
    )


def sector_zscores(panel: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = GROUP) -> DataFrame:
    """Add ``z_<metric>``, signed so that higher is better.

    Fewer than 5 values give null; no spread gives 0 for every row of the
    group, missing values included.
    """
    stats = (
        panel.where(F.col("sector").isNotNull())
        .groupBy(*by)
        .agg(
            *[
                f(m).alias(f"_{tag}_{m}")
                for m in metrics
                for tag, f in (("n", F.count), ("mu", F.avg), ("sd", F.stddev_samp))
            ]
        )
    )

    def z(m: str) -> Column:
        sign = -1.0 if m in LOWER_IS_BETTER else 1.0
        score = (F.col(m) - F.col(f"_mu_{m}")) / F.col(f"_sd_{m}") * sign
        return (
            F.when(F.col(f"_n_{m}") < MIN_GROUP, None)
            .when(F.col(f"_sd_{m}") < 1e-12, 0.0)
            .otherwise(score)
            .alias(f"z_{m}")
        )

    return panel.join(stats, list(by), "left").select(*panel.columns, *[z(m) for m in metrics])


def factor_scores(zscores: DataFrame) -> DataFrame:
    """Mean of the available signed z-scores of each factor's parts."""
    return zscores.select(
        "*", *[mean_of([f"z_{m}" for m in parts]).alias(f) for f, parts in FACTOR_PARTS.items()]
    )


def orthogonalise(
    scores: DataFrame,
    y: str = "lowvol_raw",
    x: str = "momentum_score",
    out: str = "lowvol_score",
    by: str = "calc_date",
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """Per date, the standardised residual of ``y`` regressed on ``x``.

    One grouped aggregate gives line and residual spread; a line through all
    points leaves the raw residual.
    """
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    line = (
        scores.groupBy(by)
        .agg(
            F.regr_count(y, x).alias("_n"),
            F.regr_avgx(y, x).alias("_mx"),
            F.regr_avgy(y, x).alias("_my"),
            F.try_divide(sxy, sxx).alias("_slope"),
            (syy - F.try_divide(sxy * sxy, sxx)).alias("_sse"),
        )
        .where((F.col("_n") >= min_pairs) & F.col("_slope").isNotNull())
        .select(
            by, "_mx", "_my", "_slope", F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / (F.col("_n") - 1)).alias("_sd")
        )
    )
    residual = F.col(y) - (F.col("_my") + F.col("_slope") * (F.col(x) - F.col("_mx")))
    scored = F.when(F.col("_sd") > 1e-12, residual / F.col("_sd")).otherwise(residual)
    return scores.join(line, by, "left").select(*scores.columns, scored.alias(out))


def null_counts(panel: DataFrame, metrics: Sequence[str] = METRICS, by: str = "calc_date") -> DataFrame:
    """Missing values per metric and date."""
    return panel.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(m).isNull()).alias(f"null_{m}") for m in metrics]
    )
