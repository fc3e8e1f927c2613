"""Queries that write stored tables, landed data and logs, and read them back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from crosstide.catalog.ingest import BARS, PRICE_STATS, bars, expected_symbols
from crosstide.catalog.performance import RETURNS, returns
from crosstide.catalog.registry import FILINGS, PRICES, UNIVERSE, query, r, tidy, with_
from crosstide.operators import quality
from crosstide.plans import panels
from crosstide.session import scratch_table
from crosstide.sources import commits, control, sinks, tables


def store(spark) -> str:
    """A place of its own in the shared folder."""
    return scratch_table(spark, "store").path


@query(
    "insert_batch_order",
    f"""SELECT 'C' || CAST(l_suppkey % 25 AS VARCHAR) AS country, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS rate_date,
  {r("CASE WHEN date_trunc('quarter', any_value(l_shipdate)) < DATE '1996-01-01' THEN arg_min(l_tax, l_orderkey * 10 + l_linenumber) ELSE arg_max(l_tax, l_orderkey * 10 + l_linenumber) + 1 END")} AS rate
  FROM lineitem GROUP BY 1, 2""",
)
def insert_batch_order(spark, sf):
    """The first arrival of a key is stored; later batches, repeated ones too, change nothing."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = panels.table(spark, sf, "lineitem").select(
        F.concat(F.lit("C"), (F.col("l_suppkey") % 25).cast("string")).alias("country"),
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("rate_date"),
        F.col("l_tax").alias("rate"),
        F.lit("batch").alias("source"),
        order.alias("_arrival"),
    )
    place = store(spark)
    sinks.insert_if_absent(rows.where("rate_date < '1996-01-01'"), place, "risk_free_rates")
    later = rows.withColumn("rate", F.col("rate") + 1).withColumn("_arrival", -F.col("_arrival"))
    sinks.insert_if_absent(later, place, "risk_free_rates")
    sinks.insert_if_absent(later, place, "risk_free_rates")
    return tidy(tables.read_table(spark, place, "risk_free_rates").select("country", "rate_date", "rate"))


@query(
    "insert_two_writers",
    with_(PRICES, select=f"""SELECT symbol, count(*) AS rows, {r("sum(volume + CASE WHEN year(trade_date) < 1995 THEN 0 ELSE 1 END)", 2)} AS volume FROM prices
  WHERE year(trade_date) <> 1997 GROUP BY 1 UNION ALL
  SELECT name, CASE name WHEN 'first' THEN count(*) FILTER (year(trade_date) < 1995) WHEN 'second' THEN count(*) FILTER (year(trade_date) >= 1995 AND year(trade_date) <> 1997) ELSE 0 END, NULL
  FROM prices, (VALUES ('first'), ('second'), ('second again'), ('broken off')) t(name) GROUP BY name"""),
)
def insert_two_writers(spark, sf):
    """Two batches with the keys of 1994 in common are prepared on one snapshot; the second sees the first's commit.

    A batch that is sent again adds nothing, and one that breaks off before its
    commit leaves nothing to be read.
    """
    place, prices = store(spark), panels.prices(spark, sf)
    year = F.year("trade_date")
    first = sinks.prepare_insert(prices.where(year < 1995), place, "price_data", "first")
    later = prices.where((year >= 1994) & (year != 1997)).withColumn("volume", F.col("volume") + 1)
    second = sinks.prepare_insert(later, place, "price_data", "second")
    sinks.prepare_insert(prices.where(year == 1997), place, "price_data", "broken off")
    added = {
        "first": commits.commit_insert(spark, first),
        "second": commits.commit_insert(spark, second),
        "second again": sinks.insert_if_absent(later, place, "price_data", "second"),
    }
    read = tables.read_table(spark, place, "price_data")
    added["broken off"] = read.where(year == 1997).count()
    by_symbol = read.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))
    counts = spark.createDataFrame([(k, n, None) for k, n in added.items()], "symbol string, rows bigint, volume double")
    return tidy(by_symbol.unionByName(counts), 2)


@query(
    "composite_update",
    f"""WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(last_day(l_shipdate) AS DATE) AS score_date, sum(l_tax) AS z_value, sum(l_discount) AS d
    FROM lineitem GROUP BY 1, 2)
  SELECT symbol, score_date, {r("z_value")} AS z_value, {r("CASE WHEN year(score_date) >= 1998 THEN d + 1 WHEN year(score_date) = 1997 THEN d END")} AS composite_score, NULL::BIGINT AS folders FROM g
  UNION ALL SELECT name, NULL, NULL, NULL, CASE name WHEN 'first' THEN count(DISTINCT score_date) FILTER (year(score_date) >= 1997)
    WHEN 'second' THEN count(DISTINCT score_date) FILTER (year(score_date) >= 1998) ELSE 0 END
  FROM g, (VALUES ('first'), ('first again'), ('second')) t(name) GROUP BY name""",
)
def composite_update(spark, sf):
    """Composites of 1997 onwards are set, then those of 1998 once more; names that are not stored stay out.

    The folders written anew are counted: a batch's own months, none when it is sent again.
    """
    rows = panels.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("symbol"), F.last_day("l_shipdate").alias("score_date")
    ).agg(F.sum("l_tax").alias("z_value"), F.sum("l_discount").alias("composite_score"))
    place, year = store(spark), F.year("score_date")
    sinks.write(rows.withColumn("composite_score", F.lit(None).cast("double")), place, "factor_scores")
    late = rows.where(year >= 1997)
    first = late.unionByName(late.withColumn("symbol", F.concat(F.lit("X"), "symbol")))
    second = late.where(year >= 1998).withColumn("composite_score", F.col("composite_score") + 1)
    folders = {
        "first": sinks.update_composites(first, place, "first"),
        "second": sinks.update_composites(second, place, "second"),
        "first again": sinks.update_composites(first, place, "first"),
    }
    read = tables.read_table(spark, place, "factor_scores").select("symbol", "score_date", "z_value", "composite_score")
    counts = spark.createDataFrame(list(folders.items()), "symbol string, folders bigint")
    return tidy(read.unionByName(counts, allowMissingColumns=True))


@query(
    "append_replace",
    with_(PRICES, UNIVERSE, select="""SELECT 'price_data' AS table_name, CAST(year(trade_date) AS VARCHAR) AS part, count(*) AS rows FROM prices GROUP BY 2
  UNION ALL SELECT 'company_static', '', count(*) FROM universe UNION ALL SELECT 'fail mode', 'raised', 1"""),
)
def append_replace(spark, sf):
    place, prices, names = store(spark), panels.prices(spark, sf), panels.universe(spark, sf)
    sinks.write(prices.where("trade_date < '1995-07-01'"), place, "price_data")
    sinks.write(prices.where("trade_date >= '1995-07-01'"), place, "price_data")
    for _ in range(2):
        sinks.write(names, place, "company_static", "replace")
    try:
        sinks.write(names, place, "company_static", "fail")
        raised = 0
    except AnalysisException:
        raised = 1
    by_year = tables.read_table(spark, place, "price_data").groupBy(F.year("trade_date").cast("string").alias("part"))
    out = by_year.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("price_data").alias("table_name"), "part", "rows")
    stored = tables.read_table(spark, place, "company_static").agg(F.count(F.lit(1)).alias("rows"))
    out = out.unionByName(stored.select(F.lit("company_static").alias("table_name"), F.lit("").alias("part"), "rows"))
    return out.unionByName(stored.select(F.lit("fail mode").alias("table_name"), F.lit("raised").alias("part"), F.lit(raised).cast("bigint").alias("rows")))


@query(
    "scenario_replace",
    with_(RETURNS, select=f"""SELECT scenario_id, count(*) AS months, {r("sum(net_return) + CASE WHEN scenario_id = 'baseline' THEN count(*) ELSE 0 END")} AS total FROM returns GROUP BY 1
  UNION ALL SELECT 'extra', count(*), {r('sum(net_return)')} FROM returns WHERE scenario_id = 'baseline'"""),
)
def scenario_replace(spark, sf):
    """One scenario is replaced, one appended by the plain writer, the others stay."""
    place, rows = store(spark), returns(spark, sf).select("scenario_id", "rebalance_date", "net_return")
    sinks.replace_scenarios(rows, place, "backtest_returns")
    base = rows.where("scenario_id = 'baseline'")
    sinks.write(base.withColumn("scenario_id", F.lit("extra")), place, "backtest_returns")
    sinks.replace_scenarios(base.withColumn("net_return", F.col("net_return") + 1), place, "backtest_returns")
    back = tables.read_table(spark, place, "backtest_returns").groupBy("scenario_id")
    return tidy(back.agg(F.count(F.lit(1)).alias("months"), F.sum("net_return").alias("total")))


@query("filings_keep_last", with_(FILINGS, select=f"SELECT symbol, fiscal_year, fiscal_quarter, {r('total_assets', 2)} AS total_assets FROM filings"))
def filings_keep_last(spark, sf):
    """The last arrival of a batch is stored; a later batch does not touch it."""
    place = store(spark)
    f = panels.fundamentals(spark, sf).withColumn("source", F.lit("edgar"))
    first, last = f.withColumns({"total_assets": F.lit(-1.0), "arrival": F.lit(1)}), f.withColumn("arrival", F.lit(2))
    sinks.insert_filings(last.unionByName(first), place)
    sinks.insert_filings(first, place)
    back = tables.read_table(spark, place, "financial_data")
    return tidy(back.select("symbol", "fiscal_year", "fiscal_quarter", "total_assets"), 2)


@query(
    "land_and_freshness",
    with_(PRICES, select="""SELECT symbol AS name, count(*) AS rows, CAST(symbol AS BIGINT) % 3 = 0 AS loaded, CAST(symbol AS BIGINT) % 2 = 1 AS fresh FROM prices GROUP BY 1"""),
)
def land_and_freshness(spark, sf):
    """Even symbols were landed nine days ago, odd ones five; the limit is seven."""
    place, prices = store(spark), panels.prices(spark, sf)
    number, at = F.col("symbol").cast("bigint"), lambda day: F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
    control.land(prices.where(number % 2 == 0), place, "prices", "test", at(1))
    control.land(prices.where(number % 2 == 1), place, "prices", "test", at(5))
    landed = control.read_landed(spark, place, "prices")
    control.mark_loaded(landed.where(number % 3 == 0).select(F.col("symbol").alias("name")).distinct(), place, "prices", at(6))
    state = control.current_state(spark.read.schema(control.CONTROL).parquet(f"{place}/control"))
    fresh = control.fresh(state, at(10), 7).select("name", F.lit(True).alias("fresh"))
    return state.join(fresh, "name", "left").select("name", "rows", "loaded", F.coalesce("fresh", F.lit(False)).alias("fresh"))


STALE = "CAST(symbol AS BIGINT) % 5 <> 0"


@query(
    "stale_symbols",
    with_(PRICES, FILINGS, select=f"""SELECT 'price_data' AS table_name, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM prices WHERE {STALE}
  UNION ALL SELECT 'financial_data', count(*), count(DISTINCT symbol) FROM filings WHERE {STALE}
  UNION ALL SELECT 'landed', count(*), count(DISTINCT symbol) FROM prices WHERE {STALE}
  UNION ALL SELECT 'control', count(DISTINCT symbol), count(DISTINCT symbol) FROM prices WHERE {STALE}"""),
)
def stale_symbols(spark, sf):
    """Every fifth symbol leaves the universe, and with it its stored, landed and control rows."""
    place, prices, filings = store(spark), panels.prices(spark, sf), panels.fundamentals(spark, sf)
    sinks.write(prices, place, "price_data")
    sinks.write(filings, place, "financial_data")
    control.land(prices, place, "prices", "test", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    sinks.delete_stale_symbols(spark, place, panels.universe(spark, sf).where("cast(symbol as bigint) % 5 <> 0"))
    sinks.fold_stale(spark, place, "financial_data")  # one table is read with its delete file, one without
    found = {
        "price_data": tables.read_table(spark, place, "price_data"),
        "financial_data": tables.read_table(spark, place, "financial_data"),
        "landed": control.read_landed(spark, place, "prices"),
        "control": spark.read.schema(control.CONTROL).parquet(f"{place}/control").withColumnRenamed("name", "symbol"),
    }
    out = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols")).select(F.lit(name).alias("table_name"), "rows", "symbols")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "validation_log",
    with_(BARS, UNIVERSE, FILINGS, PRICE_STATS, select="""SELECT 'prices' AS dataset, NOT (lc > 0.01 * n OR dup > 0 OR nc / n > 0.5 OR cov < 0.95) AS passed,
  CAST((lc > 0.01 * n)::INT + (dup > 0)::INT + (nc / n > 0.5)::INT + (cov < 0.95)::INT AS INTEGER) AS errors FROM s
  UNION ALL SELECT 'financials', count(*) > 0, CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS INTEGER) FROM filings"""),
)
def validation_log(spark, sf):
    """Both reports in one, judged, logged and read back."""
    place = store(spark)
    report = quality.combined_report(
        quality.validate_prices(bars(spark, sf), expected_symbols(spark, sf)),
        quality.validate_financials(panels.fundamentals(spark, sf), panels.universe(spark, sf)),
    )
    control.log_validation(quality.gate(report), place, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return spark.read.parquet(f"{place}/audit_validation").select("dataset", "passed", F.size("errors").alias("errors"))


@query(
    "stored_table_counts",
    with_(PRICES, FILINGS, UNIVERSE, select="SELECT * FROM (VALUES "
          + ", ".join(f"('{n}', 0)" for n in tables.SCHEMAS if n not in ("price_data", "financial_data", "company_static"))
          + """) t(table_name, rows) UNION ALL SELECT 'price_data', count(*) FROM prices UNION ALL SELECT 'financial_data', count(*) FROM filings
  UNION ALL SELECT 'company_static', count(*) FROM universe"""),
)
def stored_table_counts(spark, sf):
    place = store(spark)
    sinks.write(panels.prices(spark, sf), place, "price_data")
    sinks.insert_if_absent(panels.fundamentals(spark, sf), place, "financial_data")
    sinks.write(panels.universe(spark, sf), place, "company_static", "replace")
    return sinks.table_counts(spark, place)
