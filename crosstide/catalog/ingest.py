"""Queries on landed files, sinks and data quality.

Landed JSON documents are derived from the tables by Spark and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.catalog.registry import FILINGS, PRICES, PRICES_NATION, RATES, UNIVERSE, query, r, tidy, with_
from crosstide.operators import quality
from crosstide.operators.timeline import latest_by
from crosstide.plans import panels
from crosstide.session import ScratchTable
from crosstide.sources import control, landed, sinks

# --- semi-structured ------------------------------------------------------------------


@query(
    "json_extract",
    f"""SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k, CAST(max(k) AS INTEGER) AS max_k, {r('avg(value)')} AS avg_value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""",
)
def json_extract(spark, sf):
    parsed = panels.table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return tidy(parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"), F.avg("value").alias("avg_value")
    ))


@query("ticker_cik", "SELECT upper(s_name) AS symbol, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier")
def ticker_cik(spark, sf):
    s = panels.table(spark, sf, "supplier")
    docs = s.select(F.to_json(F.create_map(F.col("s_suppkey").cast("string"), F.struct(
        F.col("s_suppkey").alias("cik_str"), F.concat(F.lit(" "), F.lower("s_name")).alias("ticker"), F.col("s_name").alias("title")
    ))).alias("json"))
    return landed.ticker_to_cik(docs)


FORMS = """filed AS (SELECT DISTINCT o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders),
forms AS (SELECT c, d, CASE WHEN (c * 7 + dayofyear(d)) % 4 = 0 THEN '10-K' ELSE '10-Q' END AS form FROM filed)"""
PERIODS = """anchors0 AS (SELECT c, d, year(d) AS y, count(*) OVER w AS n, row_number() OVER (PARTITION BY c, year(d) ORDER BY d) AS i
  FROM forms WHERE form = '10-K' WINDOW w AS (PARTITION BY c, year(d))),
anchors AS (SELECT c, d, CASE WHEN n > 1 THEN CASE WHEN i = n THEN y ELSE y - 1 END WHEN month(d) <= 6 THEN y - 1 ELSE y END AS label,
  lag(d) OVER (PARTITION BY c ORDER BY d) AS prev FROM anchors0),
labelled AS (SELECT f.c, f.d, f.form, coalesce(
    (SELECT arg_min(a.label, a.d) FROM anchors a WHERE a.c = f.c AND a.d >= f.d),
    (SELECT arg_max(a.label, a.d) + 1 FROM anchors a WHERE a.c = f.c), year(f.d)) AS fy FROM forms f),
bounds AS (SELECT c, label, max(d) AS fin, arg_max(coalesce(prev, DATE '1900-01-01'), d) AS beg FROM anchors GROUP BY 1, 2),
inside AS (SELECT l.*, form = '10-Q' AND d > coalesce(beg, DATE '1900-01-01') AND d <= coalesce(fin, DATE '2999-12-31') AS ok
  FROM labelled l LEFT JOIN bounds b ON l.c = b.c AND l.fy = b.label),
numbered AS (SELECT c, d, fy, CASE WHEN form = '10-K' THEN 4 WHEN ok THEN row_number() OVER (PARTITION BY c, fy, ok ORDER BY d) END AS fq, form FROM inside)"""


def filing_forms(spark, sf):
    o = panels.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("report_date")
    ).distinct()
    day = F.dayofyear("report_date")
    return o.withColumn("form", F.when((F.col("c") * 7 + day) % 4 == 0, "10-K").otherwise("10-Q"))


@query(
    "submissions_flatten",
    with_(FORMS, select="SELECT lpad(CAST(c AS VARCHAR), 10, '0') AS cik, form, d AS report_date, CAST(d + 30 AS DATE) AS filed FROM forms"),
)
def submissions_flatten(spark, sf):
    """Each filer's arrays go out as one document and come back as rows."""
    row = F.struct("report_date", "form")
    docs = filing_forms(spark, sf).groupBy("c").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    page = F.struct(
        F.transform("rows", lambda x: x["form"]).alias("form"),
        F.transform("rows", lambda x: x["report_date"].cast("string")).alias("reportDate"),
        F.transform("rows", lambda x: F.date_add(x["report_date"], 30).cast("string")).alias("filingDate"),
    )
    doc = F.struct(F.col("c").cast("string").alias("cik"), F.struct(page.alias("recent")).alias("filings"))
    return landed.submissions(docs.select(F.to_json(doc).alias("json")))


@query(
    "fiscal_period_labels",
    with_(FORMS, PERIODS, select="""SELECT lpad(CAST(c AS VARCHAR), 10, '0') AS cik, d AS report_date, CAST(fy AS INTEGER) AS fiscal_year, CAST(fq AS INTEGER) AS fiscal_quarter
  FROM numbered WHERE form = '10-K' OR fq <= 3"""),
)
def fiscal_period_labels(spark, sf):
    filed = filing_forms(spark, sf).withColumn("cik", landed.padded_cik(F.col("c")))
    return landed.fiscal_periods(filed)


FACTS = """x AS (SELECT *, CASE WHEN (CAST(symbol AS BIGINT) + fiscal_quarter) % 3 = 0 THEN NULL ELSE total_debt END AS debt FROM filings)"""


def facts_documents(spark, sf):
    """One document of concepts per company: two concept tags for income, EPS
    basic only for every second company, year-to-date income."""
    f = panels.fundamentals(spark, sf)
    even = F.col("symbol").cast("bigint") % 2 == 0

    def fact(tag, unit, value, filed_after=40, form=None):
        return F.struct(
            F.lit(tag).alias("tag") if isinstance(tag, str) else tag.alias("tag"),
            F.lit(unit).alias("unit"),
            F.struct(
                F.col("report_date").cast("string").alias("end"),
                F.date_sub("report_date", 89).cast("string").alias("start"),
                value.cast("double").alias("val"),
                F.date_add("report_date", filed_after).cast("string").alias("filed"),
                F.lit(form or "10-Q").alias("form"),
            ).alias("row"),
        )

    income = F.when(F.col("fiscal_quarter") <= 2, "NetIncomeLoss").otherwise("ProfitLoss")
    eps_tag = F.when(even, "EarningsPerShareBasic").otherwise("EarningsPerShareDiluted")
    hole = (F.col("symbol").cast("bigint") + F.col("fiscal_quarter")) % 3 == 0
    rows = F.array(
        fact("Assets", "USD", F.col("total_assets") * 0, 10),  # restated later
        fact("Assets", "USD", F.col("total_assets")),
        fact("Assets", "USD", F.col("total_assets") * 0 - 1, 90, "8-K"),  # not a periodic form
        fact(income, "USD", F.col("net_income")),
        fact("StockholdersEquity", "USD", F.col("book_equity")),
        fact("WeightedAverageNumberOfDilutedSharesOutstanding", "shares", F.col("shares_outstanding")),
        fact(eps_tag, "USD/shares", F.col("eps")),
        fact("LongTermDebtNoncurrent", "USD", F.when(~hole, F.col("total_debt") * 0.75)),
        fact("LongTermDebtCurrent", "USD", F.when(~hole, F.col("total_debt") * 0.25)),
    )
    flat = f.select("symbol", F.inline(rows)).where("row.val is not null")
    units = flat.groupBy("symbol", "tag", "unit").agg(F.collect_list("row").alias("rows"))
    tags = units.groupBy("symbol", "tag").agg(
        F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "rows"))).alias("units")).alias("c")
    )
    docs = tags.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("tag", "c"))).alias("m"))
    doc = F.struct(F.col("symbol").alias("cik"), F.struct(F.col("m").alias("us-gaap")).alias("facts"))
    return docs.select(F.to_json(doc).alias("json"))


@query(
    "concept_fields",
    with_(FILINGS, FACTS, select=f"""SELECT lpad(symbol, 10, '0') AS cik, report_date AS "end", {r('total_assets', 2)} AS total_assets, {r('net_income', 6)} AS net_income,
  {r('book_equity', 6)} AS book_equity, {r('shares_outstanding', 0)} AS shares_outstanding, {r('debt * 0.75 + debt * 0.25', 4)} AS total_debt, {r('eps')} AS eps FROM x"""),
)
def concept_fields(spark, sf):
    out = landed.filing_fields(landed.concept_facts(facts_documents(spark, sf)))
    return tidy(out, {"total_assets": 2, "total_debt": 4, "shares_outstanding": 0})


QUARTERS = """whole AS (SELECT * FROM filings)"""


@query(
    "company_filings",
    with_(FILINGS, FACTS, """q AS (SELECT *, row_number() OVER (PARTITION BY symbol, fiscal_year, fiscal_quarter < 4 ORDER BY fiscal_quarter) AS i,
  bool_or(fiscal_quarter = 4) OVER (PARTITION BY symbol, fiscal_year) AS closed FROM x),
lab AS (SELECT *, CASE WHEN fiscal_quarter = 4 THEN 4 ELSE i END AS fq FROM q)""",
          select=f"""SELECT upper(s_name) AS symbol, fiscal_year, CAST(fq AS INTEGER) AS fiscal_quarter, report_date, {r('total_assets', 2)} AS total_assets, {r('debt * 0.75 + debt * 0.25', 4)} AS total_debt,
  {r('net_income - coalesce(lag(net_income) OVER w, 0)', 5)} AS net_income, {r('eps - coalesce(lag(eps) OVER w, 0)')} AS eps, shares_outstanding, 'edgar' AS source
  FROM lab JOIN supplier ON symbol = CAST(s_suppkey AS VARCHAR) WINDOW w AS (PARTITION BY symbol, fiscal_year ORDER BY fq)"""),
)
def company_filings(spark, sf):
    f = panels.fundamentals(spark, sf)
    form = F.when(F.col("fiscal_quarter") == 4, "10-K").otherwise("10-Q")
    filed = f.select(landed.padded_cik(F.col("symbol")).alias("cik"), form.alias("form"), "report_date")
    facts = landed.concept_facts(facts_documents(spark, sf))
    out = landed.company_filings(ticker_cik(spark, sf), filed, facts)
    return tidy(out.drop("currency", "book_equity"), {"total_assets": 2, "total_debt": 4, "net_income": 5})


def statement_documents(spark, sf):
    f = panels.fundamentals(spark, sf).withColumns({
        "y": F.col("fiscal_year").cast("string"),
        "q": F.concat(F.lit("Q"), F.col("fiscal_quarter").cast("string")),
        "d": F.col("report_date").cast("string"),
    })
    text = lambda *cols: F.array("y", "q", "d", *[F.col(c).cast("string") for c in cols])
    rows = f.groupBy("symbol").agg(
        F.collect_list(text("net_income")).alias("pl"),
        F.collect_list(F.when(F.col("fiscal_quarter") != 2, text("total_assets", "book_equity"))).alias("bs"),
        F.collect_list(F.when(F.col("fiscal_quarter") != 3, text("total_debt", "eps"))).alias("dv"),
    )
    head = ["Fiscal Year", "Fiscal Period", "Report Date"]

    def statement(name, columns, data):
        return F.struct(
            F.lit(name).alias("statement"), F.array(*[F.lit(c) for c in [*head, *columns]]).alias("columns"), F.col(data).alias("data")
        )

    parts = F.array(
        statement("pl", ["Net Income"], "pl"),
        statement("bs", ["Total Assets", "Total Equity"], "bs"),
        statement("derived", ["Total Debt", "Earnings Per Share, Diluted"], "dv"),
    )
    doc = F.array(F.struct(F.col("symbol").alias("ticker"), parts.alias("statements")))
    return rows.select(F.to_json(doc).alias("json"))


@query(
    "statement_join",
    with_(FILINGS, select=f"""SELECT symbol, fiscal_year, fiscal_quarter, report_date, {r('CASE WHEN fiscal_quarter <> 2 THEN total_assets END', 2)} AS total_assets,
  {r('CASE WHEN fiscal_quarter <> 3 THEN total_debt END', 4)} AS total_debt, {r('net_income', 6)} AS net_income,
  {r('CASE WHEN fiscal_quarter <> 2 THEN book_equity END')} AS book_equity, shares_outstanding, {r('CASE WHEN fiscal_quarter <> 3 THEN eps END')} AS eps, 'simfin' AS source FROM filings"""),
)
def statement_join(spark, sf):
    f = panels.fundamentals(spark, sf)
    day = F.col("report_date")
    shares = landed.weighted_shares(
        f.select(F.col("symbol").alias("ticker"), F.col("fiscal_year").alias("fyear"), F.concat(F.lit("q"), "fiscal_quarter").alias("period"),
                 F.col("shares_outstanding").alias("diluted"), day.cast("string").alias("endDate")).unionByName(
            f.select(F.col("symbol").alias("ticker"), F.col("fiscal_year").alias("fyear"), F.concat(F.lit("q"), "fiscal_quarter").alias("period"),
                     F.lit(1).cast("bigint").alias("diluted"), F.date_sub(day, 9).cast("string").alias("endDate")))
    )
    out = landed.statement_filings(landed.statement_rows(statement_documents(spark, sf)), shares)
    return tidy(out.drop("currency"), {"total_assets": 2, "total_debt": 4})


@query(
    "line_item_melt",
    with_(FILINGS, select=f"""SELECT symbol, fiscal_year, fiscal_quarter, report_date, {r('total_assets', 2)} AS total_assets, {r('book_equity')} AS book_equity,
  CAST(CASE WHEN fiscal_quarter = 1 THEN shares_outstanding + 5 ELSE shares_outstanding END AS BIGINT) AS shares_outstanding, {r('eps')} AS eps, 'yfinance' AS source FROM filings"""),
)
def line_item_melt(spark, sf):
    f = panels.fundamentals(spark, sf)
    first = F.col("fiscal_quarter") == 1
    wide = f.select(
        "symbol", "report_date",
        F.col("total_assets").alias("Total Assets"),
        F.when(~first, F.col("book_equity")).alias("Stockholders Equity"),
        F.when(first, F.col("book_equity")).alias("Total Stockholders Equity"),
        F.when(first, F.col("shares_outstanding") + 5.0).alias("Ordinary Shares Number"),
        F.col("shares_outstanding").cast("double").alias("Share Issued"),
        F.col("eps").alias("Diluted EPS"),
    )
    items = wide.unpivot(["symbol", "report_date"], wide.columns[2:], "item", "value")
    out = landed.line_item_filings(items)
    return tidy(out.drop("currency", "total_debt", "net_income"), {"total_assets": 2})


@query(
    "price_reshape",
    with_(PRICES_NATION, select=f"SELECT symbol, trade_date, {r('ln(adjusted_close)')} AS log_close, CAST(volume AS BIGINT) AS volume FROM prices"),
)
def price_reshape(spark, sf):
    """Prices laid out as landed wide files, one for each year, and read back."""
    p = panels.prices_nation(spark, sf).withColumn("year", F.year("trade_date"))
    names = p.select("year", "symbol").distinct().groupBy("year").agg(F.array_sort(F.collect_set("symbol")).alias("names"))
    entries = F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("adjusted_close", "volume"))))
    days = p.groupBy("year", "trade_date").agg(entries.alias("bars")).join(names, "year")

    def cells(field):
        return F.transform("names", lambda n: F.coalesce(F.try_element_at("bars", n)[field].cast("string"), F.lit("")))

    def titles(field):
        return F.transform("names", lambda n: F.concat(n, F.lit(f"|{field}")))

    rows = days.select("year", F.concat_ws(",", F.col("trade_date").cast("string"), cells("adjusted_close"), cells("volume")).alias("value"))
    heads = names.select("year", F.concat_ws(",", F.lit("Date"), titles("Adj Close"), titles("Volume")).alias("value"))
    files = ScratchTable(spark, "wide-prices").path
    heads.unionByName(rows).repartition("year").sortWithinPartitions("year", F.desc("value")).write.partitionBy("year").text(files)
    bars_back = landed.price_bars(landed.wide_price_files(spark, files))
    return tidy(bars_back.select("symbol", "trade_date", F.log("adjusted_close").alias("log_close"), "volume"))


@query("sdmx_rates", with_(RATES, select=f"SELECT CASE country WHEN 'NATION_1' THEN 'United States' WHEN 'NATION_2' THEN 'Spain' ELSE country END AS country, rate_date, {r('rate')} AS rate, 'oecd' AS source FROM rates"))
def sdmx_rates(spark, sf):
    code = F.when(F.col("country") == "NATION_1", "US").when(F.col("country") == "NATION_2", "SP").otherwise(F.col("country"))
    rows = panels.rates(spark, sf).groupBy(code.alias("code")).agg(F.array_sort(F.collect_list(F.struct("rate_date", "rate"))).alias("rows"))
    index = F.transform("rows", lambda x, i: F.struct(i.cast("string").alias("k"), F.array(x["rate"] * 100).alias("v")))
    series = F.create_map(F.lit("0:0:0"), F.struct(F.map_from_entries(index).alias("observations")))
    values = F.transform("rows", lambda x: F.struct(F.date_format(x["rate_date"], "yyyy-MM").alias("id")))
    doc = F.struct(
        F.array(F.struct(series.alias("series"))).alias("dataSets"),
        F.struct(F.struct(F.array(F.struct(values.alias("values"))).alias("observation")).alias("dimensions")).alias("structure"),
    )
    return tidy(landed.sdmx_rates(rows.select("code", F.to_json(doc).alias("json"))))


@query(
    "daily_yield_rates",
    f"""SELECT c AS country, CAST(last_day(d) AS DATE) AS rate_date, {r('arg_max(y, d) / 100')} AS rate, 'yfinance' AS source
  FROM (SELECT CAST(l_shipdate AS DATE) AS d, sum(round(l_tax * 100)) / count(*) AS y FROM lineitem GROUP BY 1), (SELECT unnest(['United States', 'Canada']) AS c) GROUP BY 1, 2""",
)
def daily_yield_rates(spark, sf):
    daily = panels.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("Date")).agg(
        (F.sum(F.round(F.col("l_tax") * 100)) / F.count(F.lit(1))).alias("Close")
    )
    return tidy(landed.daily_yield_rates(daily, ["US", "CA"]))


@query(
    "universe_load",
    with_(UNIVERSE, select="SELECT replace(replace(security, '#', '.'), '.', '-') AS symbol, sector FROM universe WHERE country IN ('NATION_1') AND symbol NOT IN ('7', '8')"),
)
def universe_load(spark, sf):
    u = panels.universe(spark, sf)
    named = u.select(
        F.concat(F.lit("  "), F.replace("security", F.lit("#"), F.lit("."))).alias("symbol"), "sector",
        F.concat(F.lower("country"), F.lit(" ")).alias("country"),
    )
    banned = u.where("cast(symbol as int) in (7, 8)").select(F.replace("security", F.lit("#"), F.lit(".")).alias("symbol"))
    return landed.tradable_universe(named, "nation_1", banned).select("symbol", "sector")


@query("universe_intersect", with_(FILINGS, PRICES, select="SELECT symbol FROM prices INTERSECT SELECT symbol FROM filings WHERE net_income < 0"))
def universe_intersect(spark, sf):
    return landed.common_symbols(panels.prices(spark, sf), panels.fundamentals(spark, sf).where("net_income < 0"))


@query(
    "missing_symbols",
    with_(UNIVERSE, PRICES, select="""SELECT 'X' || symbol AS symbol, CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN 'fetch_error' ELSE 'delisted' END AS reason FROM universe
  UNION ALL SELECT symbol, CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN 'fetch_error' ELSE 'delisted' END FROM universe WHERE symbol NOT IN (SELECT symbol FROM prices)"""),
)
def missing_symbols(spark, sf):
    wanted = expected_symbols(spark, sf)
    number = F.regexp_replace("symbol", "X", "").cast("bigint")
    # every seventh odd name has no status row, which also means delisted
    status = wanted.where((number % 2 == 0) | (number % 7 != 0)).select("symbol", (number % 2 == 0).alias("active"))
    return landed.missing_symbols(wanted, panels.prices(spark, sf), status)


# --- sinks ---------------------------------------------------------------------------------


@query(
    "dedupe_keep_last",
    f"""SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey, {r('l_extendedprice', 2)} AS l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
)
def dedupe_keep_last(spark, sf):
    rows = panels.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice")
    return tidy(latest_by(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_extendedprice"]), 2)


@query(
    "insert_if_absent",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03'
  AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-03') GROUP BY 1, 2""",
)
def insert_if_absent(spark, sf):
    events = panels.table(spark, sf, "events")
    cut = F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")
    incoming = events.where(~cut).select("user_id", "event_type", "event_id", F.col("event_id").alias("_arrival"))
    return sinks.absent_rows(incoming, events.where(cut), ["user_id", "event_type"])


@query(
    "batch_audit",
    with_(PRICES, select="SELECT symbol, CAST(year(trade_date) AS INTEGER) AS year, 'prices' AS data_type, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) AS INTEGER) AS days FROM prices GROUP BY 1, 2"),
)
def batch_audit(spark, sf):
    out = control.batch_audit(panels.prices(spark, sf), "prices")
    return out.select("symbol", "year", "data_type", "row_count", F.size("rows").alias("days"))


@query(
    "run_stage_counts",
    with_(PRICES, FILINGS, RATES, UNIVERSE, select="""SELECT 'prices' AS table_name, count(*) AS rows FROM prices UNION ALL SELECT 'filings', count(*) FROM filings
  UNION ALL SELECT 'rates', count(*) FROM rates UNION ALL SELECT 'universe', count(*) FROM universe"""),
)
def run_stage_counts(spark, sf):
    named = {"prices": panels.prices, "filings": panels.fundamentals, "rates": panels.rates, "universe": panels.universe}
    counts = [f(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, f in named.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# --- quality -------------------------------------------------------------------------------

BARS = """bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice - 1000 END AS close_price, l_discount AS open_price, l_tax - 0.01 AS high_price, l_tax AS low_price FROM lineitem)"""


def bars(spark, sf):
    l = panels.table(spark, sf, "lineitem")
    return l.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") - 1000).alias("close_price"),
        F.col("l_discount").alias("open_price"), (F.col("l_tax") - 0.01).alias("high_price"), F.col("l_tax").alias("low_price"),
    )


def expected_symbols(spark, sf):
    """The universe and as many names again that have no rows."""
    u = panels.universe(spark, sf).select("symbol")
    return u.unionByName(u.select(F.concat(F.lit("X"), "symbol").alias("symbol")))


PRICE_STATS = """s AS (SELECT count(*) AS n, count(*) FILTER (open_price <= 0) AS lo, count(*) FILTER (close_price <= 0) AS lc,
  count(*) FILTER (high_price <= 0) AS hi, count(*) FILTER (low_price <= 0) AS lw,
  (SELECT min(k) FROM (SELECT count(*) AS k FROM bars GROUP BY symbol)) AS least, (SELECT median(k) FROM (SELECT count(*) AS k FROM bars GROUP BY symbol)) AS med,
  (SELECT 2 * count(*) FROM universe) - count(DISTINCT symbol) AS miss, count(*) - count(close_price) AS nc, (max(trade_date) - min(trade_date)) / 365.25 AS years, (SELECT count(*) FROM (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) < 200)) AS thin,
  count(*) - count(DISTINCT (symbol, trade_date)) AS dup, count(DISTINCT symbol) / (SELECT 2.0 * count(*) FROM universe) AS cov FROM bars)"""


def _rule(name, value, severity, threshold="NULL"):
    return f"SELECT 'prices' AS dataset, '{name}' AS rule, {severity} AS severity, {r(value)} AS affected, CAST({threshold} AS DOUBLE) AS threshold FROM s"


@query(
    "quality_report",
    with_(BARS, UNIVERSE, PRICE_STATS, select=" UNION ALL ".join([
        _rule("empty", "CASE WHEN n = 0 THEN 1 ELSE 0 END", "CASE WHEN n = 0 THEN 'error' ELSE 'ok' END"),
        _rule("non_positive_open_price", "lo", "CASE WHEN lo > 0 THEN 'warning' ELSE 'ok' END"),
        _rule("non_positive_high_price", "hi", "CASE WHEN hi > 0 THEN 'warning' ELSE 'ok' END"),
        _rule("non_positive_low_price", "lw", "CASE WHEN lw > 0 THEN 'warning' ELSE 'ok' END"),
        _rule("non_positive_close_price", "lc", "CASE WHEN lc > 0.01 * n THEN 'error' WHEN lc > 0 THEN 'warning' ELSE 'ok' END", "0.01"),
        _rule("span_years", "years", "CASE WHEN years < 4 THEN 'warning' ELSE 'ok' END", "4"),
        _rule("thin_symbols", "thin", "CASE WHEN thin > 0 THEN 'warning' ELSE 'ok' END", "200"),
        _rule("rows_per_symbol_min", "least", "'ok'"),
        _rule("rows_per_symbol_median", "med", "'ok'"),
        _rule("missing_symbols", "miss", "CASE WHEN miss > 0 THEN 'warning' ELSE 'ok' END"),
        _rule("duplicate_keys", "dup", "CASE WHEN dup > 0 THEN 'error' ELSE 'ok' END"),
        _rule("null_close", "nc / n", "CASE WHEN nc / n > 0.5 THEN 'error' ELSE 'ok' END", "0.5"),
        _rule("symbol_coverage", "cov", "CASE WHEN cov < 0.95 THEN 'error' ELSE 'ok' END", "0.95"),
    ])),
)
def quality_report(spark, sf):
    return tidy(quality.validate_prices(bars(spark, sf), expected_symbols(spark, sf)))


@query(
    "quality_gate",
    with_(BARS, UNIVERSE, PRICE_STATS, select="""SELECT 'prices' AS dataset, NOT (lc > 0.01 * n OR dup > 0 OR nc / n > 0.5 OR cov < 0.95) AS passed,
  CAST((lc > 0.01 * n)::INT + (dup > 0)::INT + (nc / n > 0.5)::INT + (cov < 0.95)::INT AS INTEGER) AS errors FROM s"""),
)
def quality_gate(spark, sf):
    report = quality.validate_prices(bars(spark, sf), expected_symbols(spark, sf))
    return quality.gate(report).select("dataset", "passed", F.size("errors").alias("errors"))


@query("duplicate_keys", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_keys(spark, sf):
    return quality.duplicate_rows(panels.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "symbol_coverage",
    with_(UNIVERSE, select=f"""SELECT 2 * count(*) AS expected, count(*) FILTER (symbol IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)) AS present,
  2 * count(*) - count(*) FILTER (symbol IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)) AS missing,
  {r('count(*) FILTER (symbol IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)) / (2.0 * count(*))')} AS coverage FROM universe"""),
)
def symbol_coverage(spark, sf):
    return tidy(quality.symbol_coverage(bars(spark, sf), expected_symbols(spark, sf)))


FINANCIAL_RULES = (
    ("empty", "0", "CASE WHEN n = 0 THEN 'error' ELSE 'ok' END", "NULL"),
    ("non_positive_total_assets", "low", "CASE WHEN low > 0 THEN 'warning' ELSE 'ok' END", "NULL"),
    ("duplicate_keys", "dup", "CASE WHEN dup > 0 THEN 'error' ELSE 'ok' END", "NULL"),
    ("null_total_assets", "na / n", "CASE WHEN na / n > 0.5 THEN 'warning' ELSE 'ok' END", "0.5"),
    ("null_book_equity", "nb / n", "CASE WHEN nb / n > 0.5 THEN 'warning' ELSE 'ok' END", "0.5"),
    ("null_net_income", "nn / n", "CASE WHEN nn / n > 0.5 THEN 'warning' ELSE 'ok' END", "0.5"),
    ("symbol_coverage", "cov", "CASE WHEN cov < 1 THEN 'warning' ELSE 'ok' END", "NULL"),
)


@query(
    "financials_report",
    with_(FILINGS, UNIVERSE, """g0 AS (SELECT symbol, fiscal_year, fiscal_quarter, CASE WHEN fiscal_year = 1995 THEN total_assets - total_assets WHEN fiscal_year = 1996 THEN NULL ELSE total_assets END AS ta,
    CASE WHEN net_income < 0 THEN book_equity END AS be, CASE WHEN fiscal_quarter > 3 THEN net_income END AS ni FROM filings),
g AS (SELECT * FROM g0 UNION ALL SELECT * FROM g0 WHERE fiscal_year = 1997 AND fiscal_quarter = 2),
s AS (SELECT count(*) AS n, count(*) FILTER (ta <= 0) AS low, count(*) - count(DISTINCT (symbol, fiscal_year, fiscal_quarter)) AS dup, count(*) - count(ta) AS na,
    count(*) - count(be) AS nb, count(*) - count(ni) AS nn, count(DISTINCT symbol) / (SELECT 2 * count(*) FROM universe) AS cov FROM g)""",
          select=" UNION ALL ".join(
              f"SELECT 'financials' AS dataset, '{n}' AS rule, {sev} AS severity, {r(v)} AS affected, CAST({t} AS DOUBLE) AS threshold FROM s"
              for n, v, sev, t in FINANCIAL_RULES)),
)
def financials_report(spark, sf):
    f = panels.fundamentals(spark, sf).select(
        "symbol", "fiscal_year", "fiscal_quarter",
        F.when(F.col("fiscal_year") == 1995, 0.0).when(F.col("fiscal_year") != 1996, F.col("total_assets")).alias("total_assets"),
        F.when(F.col("net_income") < 0, F.col("book_equity")).alias("book_equity"),
        F.when(F.col("fiscal_quarter") > 3, F.col("net_income")).alias("net_income"),
    )
    holed = f.unionByName(f.where("fiscal_year = 1997 and fiscal_quarter = 2"))
    return tidy(quality.validate_financials(holed, expected_symbols(spark, sf)))


@query(
    "rates_report",
    with_(RATES, "s AS (SELECT count(*) FILTER (rate > 0.045) AS bad, DATE '2002-12-31' - max(rate_date) AS age, (SELECT count(*) FROM nation) + 2 - count(DISTINCT country) AS miss FROM rates)",
          select=" UNION ALL ".join(
              f"SELECT 'rates' AS dataset, '{n}' AS rule, {sev} AS severity, {r(v)} AS affected, CAST({t} AS DOUBLE) AS threshold FROM s"
              for n, v, sev, t in (
                  ("empty", "0", "'ok'", "NULL"), ("out_of_range", "bad", "CASE WHEN bad > 0 THEN 'warning' ELSE 'ok' END", "0.045"),
                  ("newest_age_days", "age", "CASE WHEN age > 365 THEN 'warning' ELSE 'ok' END", "365"), ("duplicate_keys", "0", "'ok'", "NULL"),
                  ("missing_countries", "miss", "CASE WHEN miss > 0 THEN 'warning' ELSE 'ok' END", "NULL")))),
)
def rates_report(spark, sf):
    countries = panels.table(spark, sf, "nation").select(F.col("n_name").alias("country"))
    wanted = countries.unionByName(spark.createDataFrame([("Atlantis",), ("Utopia",)], "country string"))
    as_of = F.lit("2002-12-31").cast("date")
    return tidy(quality.validate_rates(panels.rates(spark, sf), wanted, as_of, rate_high=0.045))


@query("clean_prices", with_(BARS, select=f"SELECT symbol, count(*) AS rows, {r('min(close_price)', 2)} AS lowest FROM bars WHERE close_price > 0 GROUP BY 1"))
def clean_prices(spark, sf):
    kept = quality.clean_prices(bars(spark, sf))
    return tidy(kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("close_price").alias("lowest")), 2)
