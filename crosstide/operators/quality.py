"""Data-quality rules.  Each rule yields rows (dataset, rule, severity, affected, threshold).

All counts of a dataset come from few grouped aggregates; severity 'ok' marks a
rule that holds, so a report always lists what was checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default thresholds of the rules.
THRESHOLDS = {
    "min_years": 4.0,
    "min_price_rows": 200,
    "max_null_pct": 0.5,
    "close_error_share": 0.01,
    "min_coverage": 0.95,
    "rate_low": -0.1,
    "rate_high": 1.0,
    "rate_max_age_days": 365,
}

ROW = "dataset string, rule string, severity string, affected double, threshold double"


def _report(stats: DataFrame, dataset: str, rules: Sequence[tuple[str, Column, Column, float | None]]) -> DataFrame:
    """Turn a one-row frame of statistics into one row per rule.

    A rule is (name, affected, severity, threshold).
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                severity.alias("severity"),
                affected.cast("double").alias("affected"),
                F.lit(None if threshold is None else float(threshold)).cast("double").alias("threshold"),
            )
            for name, affected, severity, threshold in rules
        ]
    )
    return stats.select(F.lit(dataset).alias("dataset"), F.inline(rows))


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row (stack, then fold)."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _when(bad: Column, level: str) -> Column:
    return F.when(bad, level).otherwise("ok")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, as a one-row frame.

    Copies are counted per key on the map side first, so a key with very many
    copies travels as one partial count.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    )


def symbol_coverage(df: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected, present and missing symbols, and present / expected."""
    present = df.select("symbol").distinct()
    wanted = expected.select("symbol").distinct()
    marks = (
        wanted.select("symbol", F.lit(1).alias("w"), F.lit(0).alias("p"))
        .unionByName(present.select("symbol", F.lit(0).alias("w"), F.lit(1).alias("p")))
        .groupBy("symbol")
        .agg(F.max("w").alias("w"), F.max("p").alias("p"))
    )
    return marks.agg(
        F.sum("w").alias("expected"),
        F.sum("p").alias("present"),
        F.count_if((F.col("w") == 1) & (F.col("p") == 0)).alias("missing"),
    ).withColumn("coverage", F.try_divide(F.col("present"), F.col("expected")))


def validate_prices(prices: DataFrame, expected: DataFrame, **limits) -> DataFrame:
    t = {**THRESHOLDS, **limits}
    low = {c: F.count_if(F.col(c) <= 0).alias(f"low_{c}") for c in ("open_price", "high_price", "low_price", "close_price")}
    counts = prices.agg(
        F.count(F.lit(1)).alias("rows"),
        *low.values(),
        F.count_if(F.col("close_price").isNull()).alias("null_close"),
        (F.datediff(F.max("trade_date"), F.min("trade_date")) / 365.25).alias("years"),
    )
    per_symbol = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count_if(F.col("_n") < t["min_price_rows"]).alias("thin"),
        F.min("_n").alias("min_rows"),
        F.percentile("_n", 0.5).alias("median_rows"),
    )
    stats = _side_by_side(
        counts, per_symbol, duplicate_rows(prices, ["symbol", "trade_date"]), symbol_coverage(prices, expected)
    )
    c = F.col
    share = F.try_divide(c("low_close_price"), c("rows"))
    null_share = F.coalesce(F.try_divide(c("null_close"), c("rows")), F.lit(0.0))
    return _report(
        stats,
        "prices",
        [
            ("empty", c("rows") == 0, _when(c("rows") == 0, "error"), None),
            *[
                (f"non_positive_{n}", c(f"low_{n}"), _when(c(f"low_{n}") > 0, "warning"), None)
                for n in ("open_price", "high_price", "low_price")
            ],
            (
                "non_positive_close_price",
                c("low_close_price"),
                F.when(share > t["close_error_share"], "error").otherwise(_when(c("low_close_price") > 0, "warning")),
                t["close_error_share"],
            ),
            ("span_years", c("years"), _when(c("years") < t["min_years"], "warning"), t["min_years"]),
            ("thin_symbols", c("thin"), _when(c("thin") > 0, "warning"), t["min_price_rows"]),
            ("rows_per_symbol_min", c("min_rows"), F.lit("ok"), None),
            ("rows_per_symbol_median", c("median_rows"), F.lit("ok"), None),
            ("duplicate_keys", c("duplicates"), _when(c("duplicates") > 0, "error"), None),
            ("null_close", null_share, _when(null_share > t["max_null_pct"], "error"), t["max_null_pct"]),
            (
                "symbol_coverage",
                c("coverage"),
                _when(c("coverage") < t["min_coverage"], "error"),
                t["min_coverage"],
            ),
            ("missing_symbols", c("missing"), _when(c("missing") > 0, "warning"), None),
        ],
    )


def validate_financials(filings: DataFrame, expected: DataFrame, **limits) -> DataFrame:
    t = {**THRESHOLDS, **limits}
    fields = ("total_assets", "book_equity", "net_income")
    counts = filings.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("total_assets") <= 0).alias("low_assets"),
        *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in fields],
    )
    stats = _side_by_side(
        counts,
        duplicate_rows(filings, ["symbol", "fiscal_year", "fiscal_quarter"]),
        symbol_coverage(filings, expected),
    )
    c = F.col

    def null_rule(f: str):
        share = F.coalesce(F.try_divide(c(f"null_{f}"), c("rows")), F.lit(0.0))
        return (f"null_{f}", share, _when(share > t["max_null_pct"], "warning"), t["max_null_pct"])

    return _report(
        stats,
        "financials",
        [
            ("empty", c("rows") == 0, _when(c("rows") == 0, "error"), None),
            ("non_positive_total_assets", c("low_assets"), _when(c("low_assets") > 0, "warning"), None),
            ("duplicate_keys", c("duplicates"), _when(c("duplicates") > 0, "error"), None),
            *[null_rule(f) for f in fields],
            ("symbol_coverage", c("coverage"), _when(c("missing") > 0, "warning"), None),
        ],
    )


def validate_rates(rates: DataFrame, expected_countries: DataFrame, as_of: Column, **limits) -> DataFrame:
    """``expected_countries`` has full country names in ``country``."""
    t = {**THRESHOLDS, **limits}
    counts = rates.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("rate") < t["rate_low"]) | (F.col("rate") > t["rate_high"])).alias("out_of_range"),
        F.max("rate_date").alias("newest"),
    )
    missing = expected_countries.select("country").distinct().join(
        rates.select("country").distinct(), "country", "left_anti"
    ).agg(F.count(F.lit(1)).alias("missing"))
    stats = _side_by_side(counts, duplicate_rows(rates, ["country", "rate_date"]), missing)
    c = F.col
    age = F.datediff(as_of, c("newest"))
    return _report(
        stats,
        "rates",
        [
            ("empty", c("rows") == 0, _when(c("rows") == 0, "error"), None),
            ("out_of_range", c("out_of_range"), _when(c("out_of_range") > 0, "warning"), t["rate_high"]),
            ("newest_age_days", age, _when(age > t["rate_max_age_days"], "warning"), t["rate_max_age_days"]),
            ("duplicate_keys", c("duplicates"), _when(c("duplicates") > 0, "error"), None),
            ("missing_countries", c("missing"), _when(c("missing") > 0, "warning"), None),
        ],
    )


def combined_report(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def gate(report: DataFrame) -> DataFrame:
    """Per dataset: passed, and the names of its warnings and errors."""
    names = {s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("rule")))) for s in ("warning", "error")}
    return report.groupBy("dataset").agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("passed"),
        names["warning"].alias("warnings"),
        names["error"].alias("errors"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("rule", F.coalesce("affected", F.lit(0.0)))))
        ).alias("stats"),
    )


def may_load(report: DataFrame, strict: bool = True) -> bool:
    """False when strict and any rule failed as an error (one small action)."""
    return not strict or report.where(F.col("severity") == "error").isEmpty()


def clean_prices(prices: DataFrame) -> DataFrame:
    """Keep rows with a positive close."""
    return prices.where(F.col("close_price") > 0)
