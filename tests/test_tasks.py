"""The number of tasks follows the rows, not the bytes that adaptive execution merges by."""

import random

from pyspark.sql import functions as F

from crosstide import session
from crosstide.functions.dates import rebalance_calendar
from crosstide.operators import ranking
from crosstide.operators.timeline import latest_by
from crosstide.plans import panels, strategy
from crosstide.plans.scenarios import Rules
from crosstide.session import materialize
from crosstide.sources import commits, sinks, tables

SF = "/root/testdata/sf0.001"


def test_bars_and_metrics_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    prices = panels.prices(spark, SF)
    assert prices.rdd.getNumPartitions() == -(-n // 500)
    plain = panels._bars(panels.trades(spark, SF).withColumn("symbol", F.col("l_suppkey").cast("string")))
    assert prices.exceptAll(plain).isEmpty() and plain.exceptAll(prices).isEmpty()

    prices, filings = materialize(prices, "prices"), materialize(panels.fundamentals(spark, SF), "filings")
    panel = strategy.metric_panel(
        prices, filings, panels.rates(spark, SF), rebalance_calendar(prices), panels.last_month_end(spark, SF), "NATION_3"
    )
    assert panel.rdd.getNumPartitions() == -(-prices.count() // 500)


def test_rows_are_ranked_where_they_are(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, -0.0, round(rng.random(), 2), rng.gauss(0, 1)]), float(i % 7)) for g in "ab" for i in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = ranking.row_ranks(df, ["g"], {"x": "rx", "y": "ry"}).toPandas()
    assert len(got) == len(rows)
    for value, rank in (("x", "rx"), ("y", "ry")):
        assert (got[rank] == got.groupby("g")[value].rank()).all()


def test_inserted_bars_stay_in_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    bars = tables.to_table(panels.prices(spark, SF), "price_data")
    keys = list(tables.KEYS["price_data"])
    unique = latest_by(bars, keys, [c for c in bars.columns if c not in keys])
    assert unique.rdd.getNumPartitions() == -(-n // 500)


def test_keys_of_two_writers_are_compared_in_tasks_by_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    written = []
    plain = commits.write_aside
    monkeypatch.setattr(commits, "write_aside", lambda df, *a: written.append(df.rdd.getNumPartitions()) or plain(df, *a))

    def rates(first, last, rate):
        days = spark.range(first, last).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("country"), F.lit("2024-01-31").cast("date").alias("rate_date"))
        return days.select("*", F.lit(rate).alias("rate"), F.lit("s").alias("source"))

    place = str(tmp_path)
    one = sinks.prepare_insert(rates(0, 100, 1.0), place, "risk_free_rates")
    two = sinks.prepare_insert(rates(40, 200, 2.0), place, "risk_free_rates")
    assert commits.commit_insert(spark, one) == 100
    assert commits.commit_insert(spark, two) == 100
    assert sinks.insert_if_absent(rates(150, 230, 3.0), place, "risk_free_rates") == 30
    stored = tables.read_table(spark, place, "risk_free_rates")
    assert {r.rate: r["count"] for r in stored.groupBy("rate").count().collect()} == {1.0: 100, 2.0: 100, 3.0: 30}
    # keys of both batches, the rest of the second, and the third against all that is stored
    assert written[2] == 16
    partitioned = tables.partition_column("risk_free_rates") is not None
    assert not partitioned or written == [10, 16, 16, 20]


def test_a_stage_of_the_run_leaves_its_table_only(spark):
    def shuffled():
        stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f"{stored.apply(i)}" for i in range(stored.size()) if stored.apply(i).getName().startswith("shuffle_")}

    prices = materialize(panels.prices(spark, SF), "prices")
    scores = materialize(panels.month_scores(spark, SF), "scores")
    panel = materialize(panels.month_panel(spark, SF), "panel")
    calendar = rebalance_calendar(prices)
    before, written = shuffled(), len(session._written)
    weights, composite = strategy.ic_and_composite(scores, prices, calendar, [Rules()], 3)
    assert not shuffled() - before and len(session._written) == written + 1
    assert weights.count() and composite.count()
    session.let_go(spark)
    before = shuffled()
    zscores, factors = strategy.score_panel(panel)
    assert not shuffled() - before and len(session._written) == written + 2
    assert zscores.count() == factors.count() == panel.count()
