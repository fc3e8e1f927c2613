"""Stored tables: schemas, business keys and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.functions.numeric import null_nans
from crosstide.operators.crosssection import METRICS
from crosstide.operators.metrics import SUMMARY_COLUMNS
from crosstide.sources import commits

# Column lists and keys of the stored tables.
SCHEMAS = {
    "company_static": "symbol string, security string, gics_sector string, gics_industry string, "
    "country string, region string",
    "price_data": "symbol string, trade_date date, open_price double, high_price double, low_price double, "
    "close_price double, adjusted_close double, currency string, volume double",
    "financial_data": "symbol string, report_date date, total_assets double, total_debt double, "
    "net_income double, book_equity double, shares_outstanding bigint, eps double, fiscal_year int, "
    "fiscal_quarter int, currency string, source string",
    "risk_free_rates": "country string, rate_date date, rate double, source string",
    "factor_metrics": "symbol string, calc_date date, " + ", ".join(f"{m} double" for m in METRICS),
    "factor_zscores": "symbol string, calc_date date, " + ", ".join(f"z_{m} double" for m in METRICS),
    "factor_scores": "symbol string, score_date date, z_value double, z_quality double, z_momentum double, "
    "z_low_vol double, composite_score double",
    "liquidity_metrics": "symbol string, calc_date date, adv_20d double, amihud_illiq double, "
    "illiq_rank_pct double, passes_adv boolean, passes_illiq boolean, passes_filter boolean",
    "ic_weights": "scenario_id string, rebalance_date date, factor_name string, ic_mean_36m double, ic_weight double",
    "selection_status": "scenario_id string, symbol string, rebalance_date date, sector string, "
    "composite_score double, percentile_rank double, status string, buffer_months_count int, "
    "entry_date date, exit_reason string",
    "portfolio_positions": "scenario_id string, rebalance_date date, symbol string, sector string, "
    "direction string, ewma_vol double, risk_adj_score double, target_weight double, final_weight double, "
    "liquidity_capped boolean, trade_action string",
    "benchmark_returns": "benchmark string, month_end date, monthly_return double",
    "backtest_returns": "scenario_id string, rebalance_date date, gross_return double, net_return double, "
    "long_return double, short_return double, benchmark_return double, excess_return double, "
    "cumulative_return double, turnover double, transaction_cost double",
    "backtest_summary": "scenario_id string, backtest_start date, backtest_end date, "
    + ", ".join(f"{c} double" for c in SUMMARY_COLUMNS[3:]),
}
KEYS = {
    "company_static": ("symbol",),
    "price_data": ("symbol", "trade_date"),
    "financial_data": ("symbol", "fiscal_year", "fiscal_quarter"),
    "risk_free_rates": ("country", "rate_date"),
    "factor_metrics": ("symbol", "calc_date"),
    "factor_zscores": ("symbol", "calc_date"),
    "factor_scores": ("symbol", "score_date"),
    "liquidity_metrics": ("symbol", "calc_date"),
    "ic_weights": ("scenario_id", "rebalance_date", "factor_name"),
    "selection_status": ("scenario_id", "symbol", "rebalance_date"),
    "portfolio_positions": ("scenario_id", "rebalance_date", "symbol"),
    "benchmark_returns": ("benchmark", "month_end"),
    "backtest_returns": ("scenario_id", "rebalance_date"),
    "backtest_summary": ("scenario_id",),
}
# How a table is laid out: by scenario, by fiscal year, or by the month of its key date.
SCENARIO_TABLES = ("backtest_returns", "backtest_summary", "portfolio_positions", "selection_status", "ic_weights")
KEY_DATES = {
    "price_data": "trade_date",
    "risk_free_rates": "rate_date",
    "factor_metrics": "calc_date",
    "factor_zscores": "calc_date",
    "factor_scores": "score_date",
    "liquidity_metrics": "calc_date",
    "benchmark_returns": "month_end",
}
# Column names of the score stage and of the stored score table.
SCORE_NAMES = {
    "calc_date": "score_date",
    "value_score": "z_value",
    "quality_score": "z_quality",
    "momentum_score": "z_momentum",
    "lowvol_score": "z_low_vol",
}


def partition_column(name: str) -> str | None:
    """The column by which a table's folders are named; ``key_month`` is no stored column."""
    if name in SCENARIO_TABLES:
        return "scenario_id"
    if name == "financial_data":
        return "fiscal_year"
    return "key_month" if name in KEY_DATES else None


def with_partition(df: DataFrame, name: str) -> DataFrame:
    """Add the column a table is laid out by, where it is not stored anyway."""
    if partition_column(name) != "key_month":
        return df
    return df.withColumn("key_month", F.date_format(KEY_DATES[name], "yyyy-MM"))


def stored_schema(name: str) -> StructType:
    """Columns of a table's files: the stored ones and the one that it is laid out by."""
    extra = ", key_month string" if partition_column(name) == "key_month" else ""
    return StructType.fromDDL(SCHEMAS[name] + extra)


def read_table(spark: SparkSession, location: str, name: str, only: list | None = None) -> DataFrame:
    """Read a stored table with its schema; NaN becomes null, symbols are trimmed.

    ``only`` lists values of the partition column; other folders are not read.
    """
    values = None if only is None or not partition_column(name) else [None if v is None else str(v) for v in only]
    return conformed(commits.read(spark, f"{location}/{name}", stored_schema(name), values), name)


def conformed(stored: DataFrame, name: str) -> DataFrame:
    """Stored rows as readers see them."""
    df = null_nans(stored.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]))
    return df.withColumn("symbol", F.trim("symbol")) if "symbol" in df.columns else df


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """Parameterised SQL over registered tables and views."""
    return spark.sql(sql, args=parameters)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, **options) -> DataFrame:
    """A database table read in parallel ranges of ``column``."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts
    )
    return null_nans(reader.options(**options).load())


def load_universe_csv(spark: SparkSession, path: str, location: str) -> DataFrame:
    """Replace the company table by a header CSV."""
    df = spark.read.schema(SCHEMAS["company_static"]).csv(path, header=True)
    commits.replace(df, f"{location}/company_static", None, only_values=False)
    return read_table(spark, location, "company_static")


def to_table(df: DataFrame, name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Project and cast a frame to the stored columns of ``name`` (missing ones null), and ``also`` some others."""
    schema = StructType.fromDDL(SCHEMAS[name])
    renamed = df.withColumnsRenamed(SCORE_NAMES) if name == "factor_scores" else df
    return renamed.select(
        *[
            (F.col(f.name) if f.name in renamed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *[c for c in also if c in renamed.columns],
    )
