"""Hand-computed cases and brute-force comparisons of the operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import backtest, crosssection, ic, metrics, positions, quality, ranking, rolling, selection, timeline
from crosstide.operators import merging
from crosstide.plans.scenarios import Rules, portfolio_scenarios, rules_table

D = dt.date


def months(n, start=2020):
    return [pd.Timestamp(x).date() for x in pd.date_range(f"{start}-01-31", periods=n, freq=pd.offsets.BMonthEnd())]


# --- ranks and quantiles -----------------------------------------------------------------


def skewed(seed=7):
    """A group with two thirds of the rows, many ties, negatives, zeros and nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        group = "hot" if i % 3 else f"g{i % 4}"
        value = rng.choice([0.0, 1.5, -2.25, rng.gauss(0, 1), rng.lognormvariate(0, 3), None])
        rows.append((i, group, value))
    return rows


def test_rank_pct_matches_pandas(spark):
    rows = skewed()
    got = ranking.rank_pct(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "v", "p").toPandas()
    frame = pd.DataFrame(rows, columns=["id", "g", "v"])
    want = frame.groupby("g")["v"].rank(pct=True)
    got = got.set_index("id")["p"].sort_index()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_group_quantiles_of_large_groups(spark):
    """Sketch bounds are in force: ties across bounds, a value that most rows share, a group without a key."""
    k = F.col("id")
    many = spark.range(600_000, numPartitions=7).select(
        F.when(k % 3 == 0, "spread").when(k % 3 == 1, "ties").alias("g"),
        F.when(k % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e3)
        .when(k % 3 == 1, F.when(k % 10 < 7, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(9)).cast("double")))
        .otherwise(F.when(k % 4 != 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(700)) / 10.0))).alias("v"),
    )
    probs = (0.0, 0.05, 0.0501, 0.5, 0.95, 1.0)
    got = {r.g: r for r in ranking.group_quantiles(many, ["g"], "v", probs).collect()}
    frame = many.toPandas()
    assert set(got) == {"spread", "ties", None}
    for g, row in got.items():
        own = frame[frame.g.isna() if g is None else frame.g == g].v.dropna()
        assert row.n == len(own) > ranking.SKETCH
        assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(own.quantile(list(probs))), rel=1e-12)


def test_group_quantiles_match_pandas(spark):
    rows = skewed()
    probs = (0.05, 0.5, 0.95)
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = ranking.group_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    want = pd.DataFrame(rows, columns=["id", "g", "v"]).groupby("g")["v"].quantile(probs).unstack()
    for i, p in enumerate(probs):
        assert np.allclose(got[f"q{i}"].sort_index(), want[p].sort_index())


def test_a_narrow_range_is_cut_into_many_buckets(spark):
    df = spark.range(200_000).selectExpr("'g' as g", "100 + id / 200000 as v")
    cells = ranking._cells(df, ["g"], "v").groupBy("_bucket").count().collect()
    assert len(cells) > 200 and max(r["count"] for r in cells) < 5 * 200_000 / len(cells)
    q = ranking.group_quantiles(df, ["g"], "v", (0.25, 1.0)).first()
    assert q.q0 == pytest.approx(100 + 0.25 * 199_999 / 200_000) and q.q1 == pytest.approx(100 + 199_999 / 200_000)


def test_winsorise_clips_the_outlier_only_in_large_groups(spark):
    rows = [(f"S{i}", "A" if i < 20 else "B", D(2024, 1, 31), 1e6 if i in (0, 20) else float(i)) for i in range(24)]
    df = spark.createDataFrame(rows + [("S99", None, D(2024, 1, 31), 3.0)], "symbol string, sector string, calc_date date, m double")
    got = {r.symbol: r.m for r in crosssection.winsorise(df, ["m"]).collect()}
    assert got["S0"] == pytest.approx(pd.Series([r[3] for r in rows[:20]]).quantile(0.95))
    assert got["S20"] == 1e6  # four names: left as it is
    assert got["S99"] is None


def test_zscore_constant_group_gives_zero_to_missing_values(spark):
    rows = [(f"S{i}", "A", D(2024, 1, 31), 0.1 if i < 6 else None) for i in range(7)]
    rows += [(f"T{i}", "B", D(2024, 1, 31), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "symbol string, sector string, calc_date date, roe double")
    got = {r.symbol: r.z_roe for r in crosssection.sector_zscores(df, ["roe"]).collect()}
    assert all(got[f"S{i}"] == 0.0 for i in range(7))
    assert all(got[f"T{i}"] is None for i in range(4))


def test_orthogonalise_is_uncorrelated_and_standardised(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    y = 0.45 * x + 0.8 * rng.normal(size=80)
    df = spark.createDataFrame([(D(2024, 1, 31), float(a), float(b)) for a, b in zip(x, y)], "calc_date date, momentum_score double, lowvol_raw double")
    e = crosssection.orthogonalise(df).toPandas()
    slope, cut = np.polyfit(x, y, 1)
    want = y - cut - slope * x
    assert np.allclose(e["lowvol_score"], want / want.std(ddof=1))
    assert crosssection.orthogonalise(df.limit(40)).where("lowvol_score is not null").count() == 0


# --- price series ------------------------------------------------------------------------


def daily(n=400, symbols=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    days = [d.date() for d in pd.bdate_range("2022-01-03", periods=n)]
    rows = []
    for k, s in enumerate(symbols):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for d, p in zip(days, price):
            if rng.random() > 0.15 * k:
                rows.append((s, d, float(p), 1000.0 + k))
    return rows


PRICE = "symbol string, trade_date date, adjusted_close double, volume double"


def test_ewma_closed_form_equals_recursion(spark):
    rows = daily(120)
    last = F.lit(D(2022, 5, 31))
    got = rolling.ewma_volatility(spark.createDataFrame(rows, PRICE), last, (0.94, 0.9)).toPandas()
    frame = pd.DataFrame(rows, columns=["s", "d", "p", "v"])
    for _, g in got.iterrows():
        p = frame[(frame.s == g.symbol) & (frame.d < g.calc_date)].sort_values("d")["p"].to_numpy()
        r = np.log(p[1:] / p[:-1])
        var = np.var(r[:20], ddof=1)
        for x in r[20:]:
            var = g.ewma_lambda * var + (1 - g.ewma_lambda) * x * x
        assert g.ewma_vol == pytest.approx(math.sqrt(252 * var), rel=1e-9)
    assert len(got) >= 12


def test_liquidity_needs_all_rows_inside_the_window(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-01", "2024-03-29")]
    rows = [("A", d, 40.0 + 0.3 * i, 81_000.0) for i, d in enumerate(days)]
    rows += [("B", d, 50.0, 10.0) for d in days[::3]]  # too thin for 20 rows in 42 days
    got = timeline.trailing_liquidity(spark.createDataFrame(rows, PRICE), F.lit(D(2024, 3, 29))).toPandas()
    a = got[(got.symbol == "A") & (got.calc_date == D(2024, 3, 29))].iloc[0]
    p = np.array([r[2] for r in rows if r[0] == "A" and r[1] < D(2024, 3, 29)])
    assert a.adtv == pytest.approx((p[-20:] * 81_000).mean())
    assert a.amihud_illiq == pytest.approx((np.abs(np.log(p[1:] / p[:-1])) / (p[1:] * 81_000))[-21:].mean(), rel=1e-9)
    assert got[got.symbol == "B"].adtv.isna().all()


def test_monthly_return(spark):
    days = [d.date() for d in pd.bdate_range("2023-05-01", periods=45)]
    rows = [("A", d, 64.0 if d.month == 5 else 80.0, 1.0) for d in days] + [("B", d, 36.0 if d.month == 5 else 27.0, 1.0) for d in days]
    got = {r.symbol: r.monthly_return for r in timeline.monthly_returns(spark.createDataFrame(rows, PRICE)).where("month_end = '2023-06-30'").collect()}
    assert got["A"] == pytest.approx(0.25) and got["B"] == pytest.approx(-0.25)


def test_asof_strict_and_not(spark):
    series = spark.createDataFrame([("A", 1, 10.0), ("A", 5, 50.0)], "k string, t int, v double")
    probes = spark.createDataFrame([("A", 5), ("A", 0), ("B", 9)], "k string, at int")
    loose = {(r.k, r["at"]): r.v for r in timeline.asof_lookup(probes, series, ["k"], "at", "t", ["v"]).collect()}
    strict = {(r.k, r["at"]): r.v for r in timeline.asof_lookup(probes, series, ["k"], "at", "t", ["v"], True).collect()}
    assert loose == {("A", 5): 50.0, ("A", 0): None, ("B", 9): None}
    assert strict[("A", 5)] == 10.0


def test_latest_by_keeps_one_row_of_many_copies(spark):
    df = spark.createDataFrame([("k", i, i % 7) for i in range(500)] + [("m", 1, 1)], "k string, arrival int, v int")
    assert sorted(map(tuple, timeline.latest_by(df, ["k"], ["arrival"]).collect())) == [("k", 499, 499 % 7), ("m", 1, 1)]


# --- information coefficient ----------------------------------------------------------------


def test_ic_weights_floor_fallback_and_exclusion(spark):
    rows = []
    for m in range(12):
        rows += [(D(2024, 1, 31), 36, m, f, v) for f, v in (("value", 0.1), ("quality", 0.3), ("momentum", -0.2), ("low_vol", 0.0))]
        rows += [(D(2024, 2, 29), 36, m, f, -0.1) for f in ic.FACTORS]
    rows += [(D(2024, 3, 29), 36, m, "value", 0.5) for m in range(11)]
    ics = spark.createDataFrame(rows, "rebalance_date date, ic_lookback_months int, month int, factor_name string, ic_value double")
    active = spark.createDataFrame(
        [(s, d, 36, x) for d in (D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 29)) for s, x in (("b", None), ("x", "quality"))],
        "scenario_id string, rebalance_date date, ic_lookback_months int, excluded_factor string",
    )
    got = {(r.scenario_id, r.rebalance_date.month, r.factor_name): r.ic_weight for r in ic.ic_weights(ics, active).collect()}
    assert got["b", 1, "value"] == pytest.approx(0.25) and got["b", 1, "quality"] == pytest.approx(0.75)
    assert got["b", 1, "momentum"] == 0.0
    assert got["x", 1, "value"] == pytest.approx(1.0) and got["x", 1, "quality"] == 0.0
    assert got["b", 2, "low_vol"] == 0.25 and got["x", 2, "value"] == pytest.approx(1 / 3)
    assert got["b", 3, "value"] == 0.25  # eleven months are too few


# --- selection --------------------------------------------------------------------------------


def test_selection_rules(spark):
    dates = months(6)
    paths = {
        "buffer_then_out": [0.97, 0.83, 0.88, 0.81, 0.92, 0.41],
        "short_recovers": [0.03, 0.13, 0.08, 0.19, 0.12, 0.17],
        "flip": [0.91, 0.02, 0.87, 0.14, 0.62, 0.55],
        "gap": [0.94, None, 0.82, 0.93, 0.89, 0.07],
    }
    rows = [("baseline", d, s, "X", 1.0, r) for s, p in paths.items() for d, r in zip(dates, p) if r is not None]
    ranked = spark.createDataFrame(rows, "scenario_id string, rebalance_date date, symbol string, sector string, composite_score double, percentile_rank double")
    out = selection.select_names(ranked, rules_table(spark, [Rules()])).collect()
    got = {s: [(r.status, r.buffer_months_count, r.exit_reason) for r in sorted(out, key=lambda r: r.ord) if r.symbol == s] for s in paths}
    assert got["buffer_then_out"] == [
        ("long_core", 0, None), ("long_buffer", 1, None), ("long_buffer", 2, None),
        ("not_selected", 0, "timer_exit"), ("long_core", 0, None), ("not_selected", 0, "hard_stop"),
    ]
    assert [x[0] for x in got["short_recovers"]] == ["short_core", "short_buffer", "short_core", "short_buffer", "short_buffer", "not_selected"]
    assert got["flip"][1] == ("short_core", 0, None) and got["flip"][2] == ("not_selected", 0, "hard_stop")
    assert got["gap"][1] == ("not_selected", 0, None)  # no row the month before: nothing remembered
    entries = [r.entry_date for r in sorted(out, key=lambda r: r.ord) if r.symbol == "short_recovers"]
    assert entries[4] == dates[0] and entries[5] is None


# --- positions ----------------------------------------------------------------------------------

BOOK = "scenario_id string, rebalance_date date, symbol string, sector string, direction string, risk_adj_score double"


def test_states_equal_a_walk_over_the_dates(spark):
    rng = random.Random(9)
    dates = months(9)
    rules = [Rules(), Rules("sens_patience_1", buffer_max_months=1)]
    rows = []
    for rule in rules:
        for k in range(60):
            for d in dates:
                if rng.random() < 0.9:
                    rows.append((rule.scenario_id, d, f"N{k}", "X", 1.0, rng.choice([0.02, 0.15, 0.15, 0.5, 0.85, 0.85, 0.98])))
    schema = "scenario_id string, rebalance_date date, symbol string, sector string, composite_score double, percentile_rank double"
    out = selection.select_names(spark.createDataFrame(rows, schema), rules_table(spark, rules)).collect()
    got = {(r.scenario_id, r.symbol, r.rebalance_date): (r.status, r.buffer_months_count, r.entry_date, r.exit_reason) for r in out}
    at = {(s, n, d): p for s, d, n, _, _, p in rows}
    for rule in rules:
        for k in range(60):
            side, months_in, entry = None, 0, None
            for d in dates:
                p = at.get((rule.scenario_id, f"N{k}", d))
                if p is None:
                    side, months_in, entry = None, 0, None
                    continue
                was, reason = side, None
                kept = (p >= 0.8 and was == "long") or (p <= 0.2 and was == "short")
                if p >= 0.9 or p <= 0.1:
                    side, status, months_in = ("long", "long_core", 0) if p >= 0.9 else ("short", "short_core", 0)
                elif kept and months_in + 1 < rule.buffer_max_months:
                    months_in += 1
                    status = f"{side}_buffer"
                else:
                    reason = "timer_exit" if kept else "hard_stop" if was else None
                    side, status, months_in = None, "not_selected", 0
                entry = None if side is None else entry if side == was else d
                assert got[rule.scenario_id, f"N{k}", d] == (status, months_in, entry, reason)


def test_sector_weights_reach_the_budgets(spark):
    rows = [("baseline", D(2024, 1, 31), f"L{i}", f"S{i % 3}", "long", float(i + 1)) for i in range(9)]
    rows += [("baseline", D(2024, 1, 31), f"Z{i}", "S0", "short", 0.0) for i in range(3)]
    got = positions.sector_weights(spark.createDataFrame(rows, BOOK)).toPandas()
    sums = got.groupby("direction")["target_weight"].sum()
    assert sums["long"] == pytest.approx(1.3) and sums["short"] == pytest.approx(0.3)
    assert got[got.direction == "short"]["target_weight"].nunique() == 1  # no score: equal weights


def test_liquidity_cap_keeps_the_total_and_loses_excess_without_takers(spark):
    d = D(2024, 1, 31)
    rows = [("baseline", d, f"A{i}", "S", "long", 0.2) for i in range(5)] + [("baseline", d, "T", "S", "short", 0.3)]
    df = spark.createDataFrame(rows, "scenario_id string, rebalance_date date, symbol string, sector string, direction string, target_weight double")
    adv = spark.createDataFrame([(f"A{i}", d, 1e9) for i in range(4)] + [("A4", d, 100.0), ("T", d, 100.0)], "symbol string, rebalance_date date, adv_20d double")
    got = positions.liquidity_cap(df, adv, rules_table(spark, [Rules(aum=1e6)])).toPandas().set_index("symbol")
    cap = 0.05 * 100 / 1e6
    assert got.loc["A4", "target_weight"] == pytest.approx(cap) and got.loc["A4", "liquidity_capped"]
    assert got[got.direction == "long"]["target_weight"].sum() == pytest.approx(1.0)
    assert got.loc["T", "target_weight"] == pytest.approx(cap)


def _walk(frame, threshold):
    """Plain walk over the dates, name by name."""
    prior, out = {}, {}
    for d, day in frame.groupby("rebalance_date"):
        held = {
            r.symbol: prior[r.symbol][1]
            for r in day.itertuples()
            if r.symbol in prior and prior[r.symbol][0] == r.direction and abs(r.target_weight - prior[r.symbol][1]) < threshold
        }
        now = {}
        for (_, side), g in day.groupby(["sector", "direction"]):
            left = g.target_weight.sum() - sum(held.get(s, 0.0) for s in g.symbol)
            open_ = g[~g.symbol.isin(held)]
            for r in g.itertuples():
                w = held[r.symbol] if r.symbol in held else left * r.target_weight / open_.target_weight.sum()
                now[r.symbol] = (side, w)
                out[d, r.symbol] = w
        prior = now
    return out


def test_no_trade_zone_follows_names_across_sectors(spark):
    rng = random.Random(5)
    rows = []
    for d in months(5):
        for i in range(14):
            if rng.random() < 0.85:
                sector = f"S{rng.randint(0, 1) if i % 3 == 0 else i % 2}"  # every third name moves about
                rows.append(("baseline", d, f"N{i}", sector, "long" if rng.random() < 0.8 else "short", 0.06 + rng.random() / 50))
    schema = "scenario_id string, rebalance_date date, symbol string, sector string, direction string, target_weight double"
    got = positions.no_trade_zone(spark.createDataFrame(rows, schema), rules_table(spark, [Rules()])).collect()
    want = _walk(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), 0.01)
    assert len(got) == len(want)
    for r in got:
        assert r.final_weight == pytest.approx(want[r.rebalance_date, r.symbol]), r
    assert {r.trade_action for r in got} == {"hold", "trade"}


# --- backtest and metrics --------------------------------------------------------------------------


def test_backtest_turnover_and_cost(spark):
    ds = months(3)
    pos = [("baseline", ds[0], "A", "long", 0.5), ("baseline", ds[0], "F", "long", 0.05), ("baseline", ds[0], "X", "long", 0.1),
           ("baseline", ds[1], "A", "long", 0.6), ("baseline", ds[1], "F", "short", 0.03), ("baseline", ds[2], "A", "long", 0.6)]
    df = spark.createDataFrame(pos, "scenario_id string, rebalance_date date, symbol string, direction string, final_weight double")
    px = [(s, d, 100.0) for s in "AFX" for d in ds[:2]] + [("A", ds[2], 110.0), ("F", ds[2], 100.0), ("X", ds[2], 0.0)]
    prices = spark.createDataFrame(px, "symbol string, calc_date date, price double")
    totals = backtest.period_totals(backtest.holding_returns(df, prices)).orderBy("ord").collect()
    assert [t.rebalance_date for t in totals] == ds[1:]
    assert totals[0].turnover == 0.0
    # A drifts by the coming 10 %; F flips (both legs); X leaves
    assert totals[1].turnover == pytest.approx(abs(0.6 - 0.55) + 0.05 + 0.03 + 0.1)
    assert totals[1].gross_return == pytest.approx(0.06)
    frame = spark.createDataFrame([("baseline", 0, D(2024, 1, 31), D(2024, 2, 29), 0.01, 0.0, 0.079, 0.30, 0.01)],
                                  "scenario_id string, ord int, held_from date, rebalance_date date, long_return double, short_return double, turnover double, short_notional double, gross_return double")
    costs = spark.createDataFrame([("baseline", 25.0, 0.0075)], "scenario_id string, cost_bps double, borrow_rate double")
    bench = spark.createDataFrame([(D(2024, 1, 31), 0.01)], "month_end date, monthly_return double")
    row = backtest.with_costs(frame, costs, bench).first()
    assert row.transaction_cost == pytest.approx(0.079 * 0.0025 + 0.3 * 0.0075 / 12)
    assert row.excess_return is None


def test_summary_metrics(spark):
    net, bench = [0.021, -0.004, -0.017, 0.033], [0.012, 0.003, -0.009, 0.024]
    rows = [("baseline", d, n, b, 0.02, 0.01, 0.3) for d, n, b in zip(months(4), net, bench)]
    df = spark.createDataFrame(rows, "scenario_id string, rebalance_date date, net_return double, benchmark_return double, long_return double, short_return double, turnover double")
    got = metrics.summary_metrics(df).first()
    total = np.prod([1 + x for x in net])
    assert got.annualised_return == pytest.approx(total**3 - 1)
    assert got.annualised_volatility == pytest.approx(np.std(net, ddof=1) * 12**0.5)
    assert got.max_drawdown == pytest.approx((1 - 0.004) * (1 - 0.017) - 1)
    assert got.tracking_error == pytest.approx(np.std(np.subtract(net, bench), ddof=1) * 12**0.5)
    assert got.sharpe_ratio == pytest.approx((total**3 - 1) / (np.std(net, ddof=1) * 12**0.5))
    one = metrics.summary_metrics(df.limit(1)).first()
    assert one.annualised_volatility == 0.0 and one.sharpe_ratio == 0.0 and one.calmar_ratio == 0.0


# --- merging and quality ----------------------------------------------------------------------------


def test_bounded_fill_and_single_quarters(spark):
    rows = [("A", 2023, q, 7.5e9 if q == 1 else None, "edgar") for q in (1, 2, 3, 4)] + [("B", 2024, 1, None, "edgar")]
    df = spark.createDataFrame(rows, "symbol string, fiscal_year int, fiscal_quarter int, total_assets double, source string")
    got = {(r.symbol, r.fiscal_quarter): (r.total_assets, r.source) for r in merging.bounded_fill(df, 2, ["total_assets"]).collect()}
    assert got["A", 2] == (7.5e9, "ffill") and got["A", 3] == (7.5e9, "ffill")
    assert got["A", 4] == (None, "edgar") and got["B", 1] == (None, "edgar")
    ytd = spark.createDataFrame([("A", 2024, 1, 8.0), ("A", 2024, 2, 19.0), ("A", 2024, 3, 33.0)], "symbol string, fiscal_year int, fiscal_quarter int, eps double")
    assert [r.eps for r in merging.standalone_quarters(ytd, ["eps"]).orderBy("fiscal_quarter").collect()] == [8.0, 11.0, 14.0]


def test_quality_gate(spark):
    rows = [("A", D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0), ("A", D(2024, 1, 1), 1.0, 1.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, open_price double, high_price double, low_price double, close_price double")
    report = quality.validate_prices(df, df.select("symbol"))
    found = {r["rule"]: r.severity for r in report.collect()}
    assert found["duplicate_keys"] == "error" and found["non_positive_close_price"] == "error"
    assert found["span_years"] == "warning" and found["symbol_coverage"] == "ok"
    assert not quality.may_load(report) and quality.may_load(report, strict=False)


def test_scenarios_are_rows(spark):
    rules = rules_table(spark, portfolio_scenarios())
    assert rules.count() == 20
    assert rules.where("scenario_id = 'sens_ewma_0.97'").first().ewma_lambda == 0.97
