"""Landed vendor files to tables: prices, filings, statements and rates.

Inputs are text or semi-structured frames as read from landed files; every
function returns a flat frame.  JSON is parsed with explicit schemas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosstide.operators.merging import conform, standalone_quarters
from crosstide.operators.timeline import latest_by

# --- prices ----------------------------------------------------------------------

# Vendor price columns and the stored names.
PRICE_COLUMNS = {
    "Open": "open_price",
    "High": "high_price",
    "Low": "low_price",
    "Close": "close_price",
    "Adj Close": "adjusted_close",
    "Volume": "volume",
}


def price_bars(lines: DataFrame, separator: str = "|", date: str = "Date") -> DataFrame:
    """Long daily bars from the lines of landed wide files with two-level column names.

    ``lines`` has ``value``, a line of comma-separated cells, and optionally ``file``;
    each file starts with its header, the one line whose first cell is ``date``.  A
    column is 'Close|ABC' or 'ABC|Close'; the level that holds the price names is found
    from each header.  Currency, if landed, is 'Currency|ABC'.

    Cells are an array beside the array of names, so the plan is the same for any number
    of symbols.  Headers are joined by file: one row for each file, of the width of a
    line.  Cells beyond the header, empty cells and columns of other names are left out; a
    line without a date gives bars without one, a file without a header none.  Where
    two cells give the same field of a (symbol, day), the greater text stands.
    """
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    wanted = {**PRICE_COLUMNS, "Currency": "currency"}
    names = F.array(*[F.lit(name) for name in wanted])
    cells = lines.select("file", F.split("value", ",", -1).alias("cells"))
    is_header = F.trim(F.col("cells")[0]) == date
    levels = F.transform("cells", lambda c: F.split(F.trim(c), f"[{separator}]", 2))
    headers = cells.where(is_header).groupBy("file").agg(F.max("cells").alias("cells")).select(
        "file", levels.alias("levels")
    )
    fields_first = F.exists("levels", lambda c: (F.size(c) == 2) & F.array_contains(names, c[0]))
    columns = headers.select(
        "file",
        F.transform(
            "levels",
            lambda c: F.when(
                F.size(c) == 2,
                F.when(fields_first, F.struct(c[0].alias("field"), c[1].alias("symbol"))).otherwise(
                    F.struct(c[1].alias("field"), c[0].alias("symbol"))
                ),
            ),
        ).alias("columns"),
    )
    rows = cells.where(~is_header).join(columns, "file")
    long = rows.select(
        F.trim(F.col("cells")[0]).try_cast("date").alias("trade_date"),
        F.inline(F.arrays_zip("columns", "cells")),
    ).where("columns is not null and trim(cells) <> ''")
    field = F.col("columns.field")
    bars = (
        long.groupBy(F.col("columns.symbol").alias("symbol"), "trade_date")
        .agg(*[F.max(F.when(field == f, F.trim("cells"))).alias(stored) for f, stored in wanted.items()])
    )
    prices = [c for c in PRICE_COLUMNS.values() if c != "volume"]
    return bars.where(F.coalesce(*prices).isNotNull()).select(
        "symbol",
        "trade_date",
        *[F.col(c).try_cast("double").alias(c) for c in prices],
        "currency",
        F.col("volume").try_cast("double").cast("bigint").alias("volume"),
    )


def wide_price_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of landed wide files with the file each is from; a large file is read in byte ranges."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def missing_symbols(expected: DataFrame, returned: DataFrame, status: DataFrame) -> DataFrame:
    """Expected symbols without rows, split by a landed (symbol, active) status table."""
    reason = F.when(F.col("active").isNull() | ~F.col("active"), "delisted").otherwise("fetch_error")
    return (
        expected.select("symbol")
        .distinct()
        .join(returned.select("symbol"), "symbol", "left_anti")
        .join(status.select("symbol", "active"), "symbol", "left")
        .select("symbol", reason.alias("reason"))
    )


# --- company filings ------------------------------------------------------------------

TICKER_SCHEMA = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
SUBMISSION_COLUMNS = "form: array<string>, reportDate: array<string>, filingDate: array<string>"
SUBMISSIONS_SCHEMA = f"struct<cik: string, filings: struct<recent: struct<{SUBMISSION_COLUMNS}>>>"
ARCHIVE_SCHEMA = f"struct<{SUBMISSION_COLUMNS}>"
FACTS_SCHEMA = (
    "struct<cik: string, facts: struct<`us-gaap`: map<string, struct<units: map<string, "
    "array<struct<end: string, start: string, val: double, filed: string, form: string>>>>>>>"
)
PERIODIC_FORMS = ("10-Q", "10-K")


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def ticker_to_cik(payload: DataFrame, text: str = "json") -> DataFrame:
    """(symbol, cik) from the landed ticker map."""
    entry = F.explode(F.map_values(F.from_json(text, TICKER_SCHEMA))).alias("e")
    return (
        payload.select(entry)
        .select(F.upper(F.trim("e.ticker")).alias("symbol"), padded_cik(F.col("e.cik_str")).alias("cik"))
        .distinct()
    )


def submissions(recent: DataFrame, archives: DataFrame | None = None, text: str = "json") -> DataFrame:
    """(cik, form, report_date, filed) from parallel arrays, recent and archived pages.

    ``archives`` has ``cik`` next to the page text.
    """
    page = F.from_json(text, SUBMISSIONS_SCHEMA)
    pages = recent.select(padded_cik(page["cik"]).alias("cik"), page["filings"]["recent"].alias("p"))
    if archives is not None:
        pages = pages.unionByName(
            archives.select(padded_cik(F.col("cik")).alias("cik"), F.from_json(text, ARCHIVE_SCHEMA).alias("p"))
        )
    rows = pages.select("cik", F.inline(F.arrays_zip("p.form", "p.reportDate", "p.filingDate")))
    return rows.select(
        "cik",
        "form",
        F.col("reportDate").try_cast("date").alias("report_date"),
        F.col("filingDate").try_cast("date").alias("filed"),
    ).where(F.col("form").isin(*PERIODIC_FORMS) & F.col("report_date").isNotNull())


def fiscal_periods(filed: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Fiscal year and quarter of each periodic filing.

    Annual reports anchor the years.  Several in one calendar year: the last one
    is that year's and the others the year before; a single one up to June
    belongs to the year before.  A filing takes the label of the first anchor on
    or after it, the year after the last label beyond the last anchor, or its
    calendar year without anchors.  Quarterly reports between two anchors are
    numbered 1 to 3 by date, later ones dropped; annual reports are quarter 4.
    """
    rows = filed if cutoff is None else filed.where(F.col("report_date") >= cutoff)
    rows = rows.select("cik", "form", "report_date")
    annual = rows.where(F.col("form") == "10-K").distinct()

    in_year = W.partitionBy("cik", F.year("report_date")).orderBy("report_date")
    year, left = F.year("report_date"), F.count(F.lit(1)).over(W.partitionBy("cik", F.year("report_date")))
    is_last = F.row_number().over(in_year) == left
    label = F.when(left > 1, F.when(is_last, year).otherwise(year - 1)).otherwise(
        F.when(F.month("report_date") <= 6, year - 1).otherwise(year)
    )
    by_date = W.partitionBy("cik").orderBy("report_date")
    anchors = annual.select("cik", F.col("report_date").alias("anchor"), label.alias("label")).select(
        "cik",
        "anchor",
        "label",
        F.lag("anchor").over(W.partitionBy("cik").orderBy("anchor")).alias("year_start"),
    )
    # year bounds of a label: its last anchor and the anchor before that
    bounds = anchors.groupBy("cik", "label").agg(
        F.max("anchor").alias("year_end"), F.max_by("year_start", "anchor").alias("year_start")
    )
    marks = annual.select("cik", "report_date").join(
        anchors.select("cik", F.col("anchor").alias("report_date"), "label"), ["cik", "report_date"]
    )
    known = rows.join(marks, ["cik", "report_date"], "left")
    ahead = F.first("label", ignorenulls=True).over(by_date.rangeBetween(W.currentRow, W.unboundedFollowing))
    behind = F.last("label", ignorenulls=True).over(by_date.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    labelled = known.withColumn(
        "fiscal_year", F.coalesce(ahead, behind + 1, F.year("report_date"))
    ).drop("label")
    placed = labelled.join(bounds.withColumnRenamed("label", "fiscal_year"), ["cik", "fiscal_year"], "left")
    quarterly = (
        (F.col("form") == "10-Q")
        & (F.col("year_start").isNull() | (F.col("report_date") > F.col("year_start")))
        & (F.col("year_end").isNull() | (F.col("report_date") <= F.col("year_end")))
    )
    order = W.partitionBy("cik", "fiscal_year", quarterly).orderBy("report_date")
    number = F.when(F.col("form") == "10-K", 4).when(quarterly, F.row_number().over(order))
    return (
        placed.withColumn("fiscal_quarter", number.cast("int"))
        .where((F.col("form") == "10-K") | (F.col("fiscal_quarter") <= 3))
        .select("cik", "report_date", F.col("fiscal_year").cast("int").alias("fiscal_year"), "fiscal_quarter")
    )


def concept_facts(payload: DataFrame, text: str = "json", cutoff: Column | None = None) -> DataFrame:
    """(cik, tag, unit, end, start, val, filed): one row per tag, unit and end date.

    Periodic forms only; the latest filing wins, then the longest period.
    """
    doc = F.from_json(text, FACTS_SCHEMA)
    tags = payload.select(padded_cik(doc["cik"]).alias("cik"), F.explode(doc["facts"]["us-gaap"]).alias("tag", "c"))
    units = tags.select("cik", "tag", F.explode("c.units").alias("unit", "rows"))
    rows = units.select("cik", "tag", "unit", F.inline("rows")).select(
        "cik", "tag", "unit", "form", "val",
        *[F.col(c).try_cast("date").alias(c) for c in ("end", "start", "filed")],
    )
    kept = rows.where(F.col("form").isin(*PERIODIC_FORMS) & F.col("end").isNotNull()).drop("form")
    if cutoff is not None:
        kept = kept.where(F.col("end") >= cutoff)
    dated = kept.withColumn("_late", F.coalesce(F.col("filed"), F.lit("1900-01-01").cast("date"))).withColumn(
        "_span", F.coalesce(F.datediff("end", "start"), F.lit(-1))
    )
    return latest_by(dated, ["cik", "tag", "unit", "end"], ["_late", "_span", "val"]).drop("_late", "_span")


# Ordered concept tags of each stored field.
CONCEPTS = {
    "total_assets": ("USD", ("Assets",)),
    "net_income": ("USD", ("NetIncomeLoss", "ProfitLoss")),
    "book_equity": (
        "USD",
        ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity"),
    ),
    "shares_outstanding": (
        "shares",
        ("CommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding"),
    ),
    "total_debt": ("USD", ("LongTermDebt", "LongTermDebtAndCapitalLeaseObligations")),
}
DEBT_PARTS = ("LongTermDebtNoncurrent", "LongTermDebtCurrent")
EPS_TAGS = ("EarningsPerShareDiluted", "EarningsPerShareBasic")
EPS_UNIT = "USD/shares"


def filing_fields(facts: DataFrame) -> DataFrame:
    """One row per (cik, end) with the stored fields from their concept chains."""

    def val(unit: str, tag: str) -> Column:
        return F.max(F.when((F.col("unit") == unit) & (F.col("tag") == tag), F.col("val")))

    chains = [
        F.coalesce(*[val(unit, tag) for tag in tags]).alias(field)
        for field, (unit, tags) in CONCEPTS.items()
        if field != "total_debt"
    ]
    unit, debt_tags = CONCEPTS["total_debt"]
    parts = [val(unit, tag) for tag in DEBT_PARTS]
    summed = F.when(
        parts[0].isNotNull() | parts[1].isNotNull(),
        F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)),
    )
    debt = F.coalesce(*[val(unit, tag) for tag in debt_tags], summed).alias("total_debt")
    # EPS is chosen per company, not per row: diluted if it has any value at all.
    series = F.max(F.struct((F.col("tag") == EPS_TAGS[0]).alias("d"))).over(W.partitionBy("cik"))["d"]
    eps_rows = facts.where((F.col("unit") == EPS_UNIT) & F.col("tag").isin(*EPS_TAGS)).withColumn("_diluted", series)
    chosen = eps_rows.where(F.col("_diluted") == (F.col("tag") == EPS_TAGS[0])).drop("_diluted")
    other = facts.where(F.col("unit") != EPS_UNIT)
    eps = F.max(F.when(F.col("unit") == EPS_UNIT, F.col("val"))).alias("eps")
    return other.unionByName(chosen).groupBy("cik", "end").agg(*chains, debt, eps)


def company_filings(
    tickers: DataFrame, filed: DataFrame, facts: DataFrame, cutoff: Column | None = None
) -> DataFrame:
    """Conformed quarterly filings: periods, fields, single-quarter flows."""
    periods = fiscal_periods(filed, cutoff)
    fields = filing_fields(facts).withColumnRenamed("end", "report_date")
    rows = (
        periods.join(fields, ["cik", "report_date"], "left")
        .join(tickers, "cik")
        .withColumn("source", F.lit("edgar"))
        .withColumn("currency", F.lit("USD"))
        .drop("cik")
    )
    return conform(standalone_quarters(latest_report(rows)))


def latest_report(rows: DataFrame) -> DataFrame:
    """Newest report date per (symbol, fiscal year, quarter)."""
    ordered = rows.withColumn("_at", F.coalesce(F.col("report_date"), F.lit("1900-01-01").cast("date")))
    order = ["_at", *[c for c in ("total_assets", "net_income", "eps") if c in rows.columns]]
    return latest_by(ordered, ["symbol", "fiscal_year", "fiscal_quarter"], order).drop("_at")


# --- vendor statements (second source) ---------------------------------------------------

STATEMENTS_SCHEMA = (
    "array<struct<ticker: string, statements: array<struct<statement: string, columns: array<string>, "
    "data: array<array<string>>>>>>"
)
# Statement columns and the stored names.
STATEMENT_FIELDS = {
    "PL": {"Net Income": "net_income"},
    "BS": {"Total Assets": "total_assets", "Total Equity": "book_equity"},
    "DERIVED": {"Total Debt": "total_debt", "Earnings Per Share, Diluted": "eps"},
}
STATEMENT_KEYS = {"Fiscal Year": "fiscal_year", "Fiscal Period": "fiscal_quarter", "Report Date": "report_date"}


def quarter_number(value) -> Column:
    """'Q1'..'Q4' or a number 1..4 (also as float text) to int, else null."""
    text = F.upper(F.trim((F.col(value) if isinstance(value, str) else value).cast("string")))
    number = F.coalesce(F.regexp_extract(text, "^Q([1-4])$", 1).try_cast("int"), text.try_cast("double").try_cast("int"))
    return F.when(number.between(1, 4), number)


def statement_rows(payload: DataFrame, text: str = "json") -> DataFrame:
    """Full outer join of the three statements on (symbol, year, quarter, report date)."""
    company = payload.select(F.inline(F.from_json(text, STATEMENTS_SCHEMA)))
    statement = company.select(F.col("ticker").alias("symbol"), F.inline("statements"))
    cells = statement.select(
        "symbol", F.upper("statement").alias("statement"), "columns", F.explode("data").alias("row")
    ).withColumn("m", F.map_from_arrays("columns", "row"))

    def one(name: str) -> DataFrame:
        fields = STATEMENT_FIELDS[name]
        needed = [*STATEMENT_KEYS, *fields]
        present = F.lit(True)
        for c in needed:
            present = present & F.array_contains("columns", c)
        return cells.where((F.col("statement") == name) & present).select(
            "symbol",
            F.try_element_at("m", F.lit("Fiscal Year")).try_cast("double").try_cast("int").alias("fiscal_year"),
            quarter_number(F.try_element_at("m", F.lit("Fiscal Period"))).alias("fiscal_quarter"),
            F.try_element_at("m", F.lit("Report Date")).try_cast("date").alias("report_date"),
            *[F.try_element_at("m", F.lit(c)).try_cast("double").alias(s) for c, s in fields.items()],
        )

    keys = ["symbol", "fiscal_year", "fiscal_quarter", "report_date"]
    return one("PL").join(one("BS"), keys, "full").join(one("DERIVED"), keys, "full")


def weighted_shares(payload: DataFrame) -> DataFrame:
    """Diluted shares per quarter, the latest end date first.

    Columns: ticker, fyear, period, diluted, endDate.
    """
    rows = payload.select(
        F.col("ticker").alias("symbol"),
        F.col("fyear").cast("string").try_cast("double").try_cast("int").alias("fiscal_year"),
        quarter_number("period").alias("fiscal_quarter"),
        F.col("diluted").cast("string").try_cast("double").alias("shares_outstanding"),
        F.coalesce(F.col("endDate").try_cast("date"), F.lit("1900-01-01").cast("date")).alias("end_date"),
    ).where("fiscal_year is not null and fiscal_quarter is not null")
    return latest_by(
        rows, ["symbol", "fiscal_year", "fiscal_quarter"], ["end_date", "shares_outstanding"]
    ).drop("end_date")


def statement_filings(statements: DataFrame, shares: DataFrame) -> DataFrame:
    """Conformed filings of the statement vendor."""
    rows = (
        statements.where("fiscal_year is not null and fiscal_quarter is not null")
        .join(shares, ["symbol", "fiscal_year", "fiscal_quarter"], "left")
        .withColumn("source", F.lit("simfin"))
    )
    return latest_report(conform(rows))


# --- line-item matrices (third source) ------------------------------------------------------

# Line items of each stored field, in order of preference.
LINE_ITEMS = {
    "total_assets": ("Total Assets",),
    "total_debt": ("Total Debt",),
    "book_equity": ("Stockholders Equity", "Total Stockholders Equity"),
    "shares_outstanding": ("Ordinary Shares Number", "Share Issued"),
    "net_income": ("Net Income",),
    "eps": ("Diluted EPS",),
}


def line_item_filings(items: DataFrame) -> DataFrame:
    """Filings from long line items (symbol, report_date, item, value).

    Calendar quarters; the first non-null line item of each field wins.
    """
    rows = items.select(
        "symbol",
        F.to_date("report_date").alias("report_date"),
        "item",
        F.col("value").cast("double").alias("value"),
    ).where("value is not null")

    def pick(item: str) -> Column:
        return F.min_by(F.when(F.col("item") == item, F.col("value")), F.when(F.col("item") == item, F.col("report_date")))

    per_quarter = rows.groupBy(
        "symbol",
        F.year("report_date").alias("fiscal_year"),
        F.quarter("report_date").alias("fiscal_quarter"),
    ).agg(
        F.min("report_date").alias("report_date"),
        *[F.coalesce(*[pick(i) for i in names]).alias(field) for field, names in LINE_ITEMS.items()],
    )
    return conform(per_quarter.withColumn("currency", F.lit("USD")).withColumn("source", F.lit("yfinance")))


# --- rates ------------------------------------------------------------------------------------

# Country codes, names and the codes of the rate provider.
COUNTRY_NAMES = {
    "US": "United States",
    "GB": "United Kingdom",
    "CA": "Canada",
    "FR": "France",
    "DE": "Germany",
    "CH": "Switzerland",
    "IT": "Italy",
    "SP": "Spain",
}
RATE_CODES = {
    "US": "USA",
    "GB": "GBR",
    "CA": "CAN",
    "FR": "FRA",
    "DE": "DEU",
    "CH": "CHE",
    "IT": "ITA",
    "SP": "ESP",
}
SDMX_SCHEMA = (
    "struct<dataSets: array<struct<series: map<string, struct<observations: map<string, array<double>>>>>>, "
    "structure: struct<dimensions: struct<observation: array<struct<values: array<struct<id: string>>>>>>>"
)


def country_name(code) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    names = F.create_map(*[F.lit(v) for pair in COUNTRY_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def sdmx_rates(payload: DataFrame, text: str = "json", code: str = "code") -> DataFrame:
    """(country, rate_date, rate, source) from one landed document per country code."""
    doc = F.from_json(text, SDMX_SCHEMA)
    observations = F.try_element_at(F.get(doc["dataSets"], F.lit(0))["series"], F.lit("0:0:0"))["observations"]
    periods = F.get(doc["structure"]["dimensions"]["observation"], F.lit(0))["values"]
    rows = payload.select(code, periods.alias("periods"), F.explode(observations).alias("i", "vals"))
    return rows.select(
        country_name(code).alias("country"),
        F.to_date(F.concat(F.get("periods", F.col("i").cast("int"))["id"], F.lit("-01"))).alias("rate_date"),
        (F.get("vals", F.lit(0)) / 100).alias("rate"),
        F.lit("oecd").alias("source"),
    ).where("rate is not null and rate_date is not null")


def daily_yield_rates(yields: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Month-end last daily yield (percent) as a rate, repeated for each country."""
    monthly = (
        yields.where("Close is not null")
        .groupBy(F.last_day(F.to_date("Date")).alias("rate_date"))
        .agg((F.max_by("Close", "Date") / 100).alias("rate"))
    )
    names = F.array(*[F.lit(COUNTRY_NAMES.get(c, c)) for c in countries])
    return monthly.select(F.explode(names).alias("country"), "rate_date", "rate", F.lit("yfinance").alias("source"))


def dedupe_rates(rates: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Last arrival per (country, rate_date)."""
    return latest_by(rates, ["country", "rate_date"], [arrival])


# --- universe ---------------------------------------------------------------------------------


def tradable_universe(companies: DataFrame, country: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Trimmed and normalised symbols of the company table, without those of ``exclude`` (symbol)."""
    trimmed = companies.withColumns({c: F.trim(c) for c in companies.columns if c in ("symbol", "country")})
    if country:
        trimmed = trimmed.where(F.upper("country") == country.upper())
    kept = trimmed.where(F.col("symbol").isNotNull())
    if exclude is not None:
        kept = kept.join(exclude.select(F.trim("symbol").alias("symbol")), "symbol", "left_anti")
    named = kept.withColumn("symbol", F.replace("symbol", F.lit("."), F.lit("-")))
    rest = [c for c in named.columns if c != "symbol"]
    return latest_by(named, ["symbol"], rest) if rest else named.distinct()


def common_symbols(prices: DataFrame, filings: DataFrame) -> DataFrame:
    """Symbols that have both prices and filings."""
    return prices.select("symbol").distinct().join(filings.select("symbol"), "symbol", "left_semi")
