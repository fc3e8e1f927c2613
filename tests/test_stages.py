"""Stored stages: what a run computes again, and what it leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosstide.plans.stages import Read, Source, Stage, fingerprints, run_stages, stored_rows
from crosstide.sources import commits

MONTHS = [f"2024-{m:02d}" for m in range(1, 7)]


def rates(spark, changed=None):
    rows = [("X", dt.date(2024, m, 10), float(m), "s") for m in range(1, 7)] + [("Y", dt.date(2024, m, 20), 1.0, "s") for m in range(1, 7)]
    if changed:
        rows.append(changed)
    return spark.createDataFrame(rows, "symbol string, day date, rate double, source string")


def metrics(x):
    monthly = x["rates"].groupBy("symbol", F.last_day("day").alias("calc_date")).agg(F.sum("rate").alias("pb_ratio"))
    return monthly


def zscores(x):
    return x["factor_metrics"].select("symbol", "calc_date", F.least("pb_ratio", F.lit(5.0)).alias("z_pb_ratio"))


def benchmark(x):
    by_month = x["rates"].groupBy(F.last_day("day").alias("month_end")).agg(F.sum("rate").alias("total"))
    before = by_month.select(F.last_day(F.add_months("month_end", 1)).alias("month_end"), F.col("total").alias("before"))
    return by_month.join(before, "month_end").select(F.lit("b").alias("benchmark"), "month_end", (F.col("total") - F.col("before")).alias("monthly_return"))


def stages(rule=""):
    return (
        Stage("factor_metrics", (Read("rates"),), metrics),
        Stage("factor_zscores", (Read("factor_metrics"),), zscores, rule),
        Stage("benchmark_returns", (Read("rates", back=1),), benchmark),
    )


def run(spark, place, rows, rule="", months=MONTHS):
    return set(run_stages(spark, place, {"rates": Source(rows, "day")}, stages(rule), months))


def contents(spark, place):
    return {t: sorted(map(tuple, stored_rows(spark, place, t).collect()), key=str) for t in ("factor_metrics", "factor_zscores", "benchmark_returns")}


def test_only_what_changed_is_computed(spark, tmp_path):
    place, other = str(tmp_path / "a"), str(tmp_path / "b")
    assert run(spark, place, rates(spark)) == {(s.table, m) for s in stages() for m in MONTHS}
    assert run(spark, place, rates(spark).repartition(3)) == set()
    late = rates(spark, ("Z", dt.date(2024, 3, 5), 2.0, "s"))
    assert run(spark, place, late) == {("factor_metrics", "2024-03"), ("factor_zscores", "2024-03"), ("benchmark_returns", "2024-03"), ("benchmark_returns", "2024-04")}
    run(spark, other, late)
    assert contents(spark, place) == contents(spark, other)
    assert run(spark, place, late, rule="other") == {("factor_zscores", m) for m in MONTHS}
    # rows that go again take their results along
    run(spark, place, rates(spark), rule="other")
    assert not any(r[0] == "Z" for r in contents(spark, place)["factor_metrics"])


def test_an_unchanged_result_stops_there(spark, tmp_path):
    place = str(tmp_path)
    run(spark, place, rates(spark, ("X", dt.date(2024, 6, 5), 4.0, "s")))
    more = rates(spark, ("X", dt.date(2024, 6, 5), 5.0, "s"))
    capped = (*stages()[:1], Stage("factor_scores", (Read("factor_metrics"),), lambda x: x["factor_metrics"].select("symbol", F.col("calc_date").alias("score_date"), F.lit(1.0).alias("z_value"))),
              Stage("liquidity_metrics", (Read("factor_scores"),), lambda x: x["factor_scores"].select("symbol", F.col("score_date").alias("calc_date"))))
    first = run_stages(spark, place, {"rates": Source(rates(spark), "day")}, capped, MONTHS)
    again = run_stages(spark, place, {"rates": Source(more, "day")}, capped, MONTHS)
    assert ("liquidity_metrics", "2024-06") in first
    assert again == [("factor_metrics", "2024-06"), ("factor_scores", "2024-06")]


def test_a_run_that_breaks_off_is_taken_up(spark, tmp_path, monkeypatch):
    place, other = str(tmp_path / "a"), str(tmp_path / "b")
    replace, calls = commits.replace, []

    def broken(df, root, *args, **kw):
        calls.append(root)
        if len(calls) == 4:  # the second stage's rows are stored, their fingerprints are not
            raise RuntimeError("lost")
        return replace(df, root, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(commits, "replace", broken)
        with pytest.raises(RuntimeError):
            run(spark, place, rates(spark))
    assert {t for t, _ in run(spark, place, rates(spark))} == {"factor_zscores", "benchmark_returns"}
    run(spark, other, rates(spark))
    assert contents(spark, place) == contents(spark, other)


def test_new_months_empty_inputs_and_nulls(spark, tmp_path):
    place = str(tmp_path)
    run(spark, place, rates(spark), months=MONTHS[:4])
    assert run(spark, place, rates(spark)) == {(s.table, m) for s in stages() for m in MONTHS[4:]}
    assert run(spark, str(tmp_path / "e"), rates(spark).limit(0)) == {(s.table, m) for s in stages() for m in MONTHS}
    odd = spark.createDataFrame([(None, None, None, None), ("X", dt.date(2024, 1, 1), None, "s")] * 2, "symbol string, day date, rate double, source string")
    assert set(fingerprints(odd, "day")) == {None, "2024-01"}
    assert fingerprints(odd, "day") != fingerprints(odd.distinct(), "day")


def test_fingerprints_sum_whole_numbers(spark):
    """Thirds of two hashes as 64-bit sums; decimals of 38 digits took most of a fingerprint's time."""
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 5)), (2, None)], "v int, day date")
    found = fingerprints(rows, "day")
    assert {m: len(f.split(":")) for m, f in found.items()} == {None: 7, "2024-01": 7}
    assert found["2024-01"].startswith("2:")
