"""Stored tables, control rows, streaming inserts, landed formats, calendar and text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosstide.functions import dates, text
from crosstide.operators import merging
from crosstide.sources import control, landed, sinks, tables
from crosstide.streaming.incremental import stream_inserts

D = dt.date


def test_insert_if_absent_keeps_the_stored_row(spark, tmp_path):
    rates = "country string, rate_date date, rate double, source string"
    first = spark.createDataFrame([("X", D(2024, 1, 1), 0.01, "a")], rates)
    again = spark.createDataFrame([("X", D(2024, 1, 1), 0.99, "b"), ("Y", D(2024, 1, 1), 0.02, "b")], rates)
    assert sinks.insert_if_absent(first, str(tmp_path), "risk_free_rates") == 1
    assert sinks.insert_if_absent(again, str(tmp_path), "risk_free_rates") == 1
    got = {r.country: r.rate for r in tables.read_table(spark, str(tmp_path), "risk_free_rates").collect()}
    assert got == {"X": 0.01, "Y": 0.02}
    counts = {r.table_name: r.rows for r in sinks.table_counts(spark, str(tmp_path)).collect()}
    assert counts["risk_free_rates"] == 2 and counts["price_data"] == 0


def test_replace_scenarios_leaves_others(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame(pairs, "scenario_id string, net_return double").withColumn("rebalance_date", F.lit(D(2024, 1, 31)))

    sinks.replace_scenarios(rows(("a", 0.1), ("b", 0.2)), str(tmp_path), "backtest_returns")
    sinks.replace_scenarios(rows(("b", 0.5)), str(tmp_path), "backtest_returns")
    got = tables.read_table(spark, str(tmp_path), "backtest_returns").collect()
    assert sorted((r.scenario_id, r.net_return) for r in got) == [("a", 0.1), ("b", 0.5)]


def test_stream_inserts_new_keys_once(spark, tmp_path):
    schema = "country string, rate_date date, rate double, source string"
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    for k in (1, 2):
        spark.createDataFrame([("X", D(2024, 1, 1), 0.1 * k, "s"), (f"C{k}", D(2024, 1, 1), 0.1, "s")], schema).write.mode("append").parquet(src)
        stream_inserts(spark.readStream.schema(schema).parquet(src), store, "risk_free_rates", str(tmp_path / "cp")).awaitTermination()
    got = tables.read_table(spark, store, "risk_free_rates").orderBy("country").collect()
    assert [(r.country, round(r.rate, 3)) for r in got] == [("C1", 0.1), ("C2", 0.1), ("X", 0.1)]


def test_control_freshness_and_load_marks(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0)], "symbol string, v double")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    control.land(rows, str(tmp_path), "prices", "test", at)
    control.mark_loaded(spark.createDataFrame([("A",)], "name string"), str(tmp_path), "prices", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    state = control.current_state(spark.read.schema(control.CONTROL).parquet(f"{tmp_path}/control"))
    assert {r.name: r.loaded for r in state.collect()} == {"A": True, "B": False}
    late = F.lit("2024-01-09 12:00:00").cast("timestamp")
    assert control.fresh(state, late, 7).count() == 0 and control.fresh(state, late, 8).count() == 2
    assert control.fresh(state, late, None).count() == 2


def test_source_routing(spark):
    cols = "symbol string, fiscal_year int, fiscal_quarter int, report_date date, priority int, source string, " + ", ".join(f"{c} double" for c in merging.FILL_FIELDS)
    rows = [
        ("A", 2024, 1, D(2024, 3, 31), 1, "edgar", 3e11, 1.0, None, 1e11, 5.0, 1.0),
        ("A", 2024, 1, D(2024, 3, 30), 2, "simfin", 2.9e11, 1.0, 2e10, 9e10, 5.0, 1.0),
        ("A", 2024, 2, D(2024, 6, 30), 2, "simfin", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("B", 2024, 1, D(2024, 3, 31), 1, "edgar", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("B", 2023, 4, D(2023, 12, 31), 2, "simfin", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
    ]
    got = {(r.symbol, r.fiscal_year, r.fiscal_quarter): r for r in merging.route_sources(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {("A", 2024, 1), ("A", 2024, 2), ("B", 2024, 1)}  # B was complete, so nothing is added
    first = got["A", 2024, 1]
    assert (first.total_assets, first.net_income, first.book_equity, first.source) == (3e11, 2e10, 1e11, "edgar")
    with pytest.raises(ValueError):
        merging.route_sources(spark.createDataFrame(rows, cols), "nowhere")


def test_calendar_and_text(spark):
    days = [D(2024, 3, 31), D(2024, 3, 29), D(2024, 6, 30), D(2024, 7, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", dates.business_month_end("d").alias("e"), dates.month_end_before("d", 1).alias("b")).collect()
    assert [(r.e, r.b) for r in got] == [
        (D(2024, 3, 29), D(2024, 3, 29)), (D(2024, 3, 29), D(2024, 2, 29)), (D(2024, 6, 28), D(2024, 6, 28)), (D(2024, 7, 31), D(2024, 6, 28)),
    ]
    assert dates.calendar_ending(spark, "2024-04-02", 1).count() == 14
    row = spark.range(1).select(
        text.percent(F.lit(0.0316)).alias("p"), text.percent(F.lit(None).cast("double")).alias("n"), text.compact(F.lit(1.5e6)).alias("m"),
        text.scenario_label(F.lit("sens_sel_0.05")).alias("s"), dates.period_years(F.lit("10y")).alias("y"), dates.period_years(F.lit("max")).alias("z"),
        landed.quarter_number(F.lit("3.0")).alias("q"), landed.country_name(F.lit("GB")).alias("c"),
    ).first()
    assert tuple(row) == ("3.16%", "-", "1.5M", "Sensitivity: selection threshold = 0.05", 10, None, 3, "United Kingdom")


def test_every_check_sql_has_its_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 90


WIDE = "file string, value string"


def test_wide_price_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Close|AA,Close|B.B,Volume|AA,Currency|AA,Other|AA\n2024-01-02,1.5,,10,USD,9\n2024-01-03,x,2.25,11.0,,9,7,7\n")
    (tmp_path / "b.csv").write_text("Date,CC|Adj Close,CC|Close\n2024-01-02,3,\n2024-01-04,,\n")
    (tmp_path / "c.csv").write_text("2024-01-02,1\n")  # no header
    got = landed.price_bars(landed.wide_price_files(spark, str(tmp_path))).collect()
    found = {(r.symbol, str(r.trade_date)): (r.close_price, r.adjusted_close, r.volume, r.currency) for r in got}
    assert found == {
        ("AA", "2024-01-02"): (1.5, None, 10, "USD"),
        ("AA", "2024-01-03"): (None, None, 11, None),
        ("B.B", "2024-01-03"): (2.25, None, None, None),
        ("CC", "2024-01-02"): (None, 3.0, None, None),
    }
    assert len(got) == 4
    assert landed.price_bars(spark.createDataFrame([], WIDE)).count() == 0


def test_wide_price_plan_does_not_grow_with_symbols(spark):
    sizes = []
    for n in (25, 5000):
        head = ",".join(["Date"] + [f"Close|S{i}" for i in range(n)])
        lines = [("f", head), ("f", ",".join(["2024-01-02"] + [str(i) for i in range(n)]))]
        bars = landed.price_bars(spark.sparkContext.parallelize(lines, 2).toDF(WIDE))
        sizes.append(bars._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        assert bars.agg(F.sum("close_price")).first()[0] == n * (n - 1) / 2
    assert sizes[0] == sizes[1]
