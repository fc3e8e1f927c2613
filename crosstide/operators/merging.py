"""Merging and conforming fundamentals from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Filing key, filled fields, conformed columns, legacy names.
FILING_KEY = ("symbol", "fiscal_year", "fiscal_quarter")
FILL_FIELDS = ("total_assets", "total_debt", "net_income", "book_equity", "shares_outstanding", "eps")
CONFORMED = {
    "symbol": "string",
    "report_date": "date",
    "total_assets": "double",
    "total_debt": "double",
    "net_income": "double",
    "book_equity": "double",
    "shares_outstanding": "bigint",
    "eps": "double",
    "fiscal_year": "int",
    "fiscal_quarter": "int",
    "currency": "string",
    "source": "string",
}


def waterfall_merge(rows: DataFrame, early_exit: bool = True) -> DataFrame:
    """Merge sources field by field, the lowest ``priority`` with a value first.

    ``source`` is the best source that has the row.  With ``early_exit`` a
    symbol's lower sources are read only while a fill field is still missing in
    the quarters present so far, so they add no quarters to a complete symbol.
    """
    used = _until_complete(rows) if early_exit else rows
    fields = [c for c in used.columns if c not in (*FILING_KEY, "priority", "source")]

    def best(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("priority"))).alias(c)

    return used.groupBy(*FILING_KEY).agg(
        *[best(c) for c in fields], F.min_by("source", "priority").alias("source")
    )


def _until_complete(rows: DataFrame) -> DataFrame:
    """Drop the rows of a source when the better ones already filled the symbol.

    Completeness after source p: every (symbol, year, quarter) seen in sources
    up to p has all fill fields from sources up to p.  The priorities are few,
    so each cell's first source with a value decides it.
    """
    cells = rows.groupBy(*FILING_KEY).agg(
        F.min("priority").alias("_seen"),
        *[F.min(F.when(F.col(c).isNotNull(), F.col("priority"))).alias(f"_p_{c}") for c in FILL_FIELDS],
    )
    never = F.lit(2_000_000_000)
    filled = F.greatest(*[F.coalesce(F.col(f"_p_{c}"), never) for c in FILL_FIELDS])
    # A quarter is open for p in [seen, filled): the symbol needs the next source.
    spans = cells.select("symbol", F.col("_seen").alias("open_from"), filled.alias("open_until"))
    ladder = rows.select("symbol", "priority").distinct()
    open_after = (
        ladder.join(spans, "symbol")
        .groupBy("symbol", "priority")
        .agg(F.max((F.col("open_from") <= F.col("priority")) & (F.col("priority") < F.col("open_until"))).alias("_open"))
    )
    w = W.partitionBy("symbol").orderBy("priority").rowsBetween(W.unboundedPreceding, -1)
    reached = open_after.withColumn("_go", F.coalesce(F.min("_open").over(w), F.lit(True)))
    return rows.join(reached.where("_go").select("symbol", "priority"), ["symbol", "priority"], "left_semi")


def bounded_fill(filings: DataFrame, limit: int = 2, fields: Sequence[str] = FILL_FIELDS) -> DataFrame:
    """Carry a field over at most ``limit`` quarters; mark rows that were all null."""
    w = W.partitionBy("symbol").orderBy("fiscal_year", "fiscal_quarter").rowsBetween(-limit, 0)
    blank, filled = F.lit(True), F.lit(False)
    for c in fields:
        blank = blank & F.col(c).isNull()
        filled = filled | F.last(c, ignorenulls=True).over(w).isNotNull()
    source = F.when(blank & filled, "ffill").otherwise(F.col("source"))
    return filings.select(
        *[
            F.last(c, ignorenulls=True).over(w).alias(c)
            if c in fields
            else (source.alias(c) if c == "source" else F.col(c))
            for c in filings.columns
        ]
    )


def standalone_quarters(filings: DataFrame, fields: Sequence[str] = ("net_income", "eps")) -> DataFrame:
    """Year-to-date values to single quarters; a gap restarts the subtraction."""
    w = W.partitionBy("symbol", "fiscal_year").orderBy("fiscal_quarter")
    return filings.select(
        *[
            (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))).alias(c) if c in fields else F.col(c)
            for c in filings.columns
        ]
    )


def last_quarters(filings: DataFrame, period: str) -> DataFrame:
    """Newest 4N quarters per symbol for 'Ny'; everything for 'max' or other text."""
    text = period.strip().lower()
    if not (text.endswith("y") and text[:-1].isdigit()):
        return filings
    w = W.partitionBy("symbol").orderBy(F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc())
    return filings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 4 * int(text[:-1])).drop("_n")


def conform(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Fixed columns and types: rename, add missing as null, cast what can be cast."""
    named = df.withColumnsRenamed({k: v for k, v in (renames or {}).items() if k in df.columns and v not in df.columns})

    def column(c: str, t: str) -> Column:
        if c not in named.columns:
            raw = F.lit(None).cast(t)
        elif c == "shares_outstanding":
            raw = F.round(F.col(c).try_cast("double"), 0).try_cast("bigint")
        elif t == "int":
            raw = F.col(c).try_cast("double").try_cast("int")
        else:
            raw = F.col(c).try_cast(t)
        return (F.coalesce(raw, F.lit("unknown")) if c == "source" else raw).alias(c)

    return named.select(*[column(c, t) for c, t in CONFORMED.items()])


def first_nonempty_source(rows: DataFrame, dataset: Sequence[str] = ()) -> DataFrame:
    """Rows of the best (lowest) priority that has any, per dataset key."""
    best = rows.groupBy(*dataset).agg(F.min("priority").alias("priority"))
    return rows.join(best, [*dataset, "priority"], "left_semi")


SOURCES = ("edgar", "simfin", "yfinance")


def route_sources(rows: DataFrame, source: str = "waterfall", period: str = "max") -> DataFrame:
    """Single source or waterfall, then fill, conform and the newest quarters."""
    if source == "waterfall":
        merged = waterfall_merge(rows)
    elif source in SOURCES:
        merged = rows.where(F.col("source") == source).drop("priority")
    else:
        raise ValueError(f"source must be 'waterfall' or one of {SOURCES}, got {source!r}")
    return last_quarters(conform(bounded_fill(merged)), period)
