"""Scenarios as rows: one row per scenario, one column per parameter."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Liquidity:
    adtv_rows: int = 20
    illiq_rows: int = 21
    illiq_removal_pct: float = 0.10
    adtv_min_dollar: float = 1_000_000.0
    window_days: int = 42
    sizing_window_days: int = 60


@dataclass(frozen=True)
class Rules:
    """Everything that may differ between scenarios (defaults = baseline)."""

    scenario_id: str = "baseline"
    ic_lookback_months: int = 36
    excluded_factor: str | None = None
    selection_threshold: float = 0.10
    buffer_exit_threshold: float = 0.20
    buffer_max_months: int = 3
    ewma_lambda: float = 0.94
    aum: float = 50_000_000.0
    liquidity_cap_pct: float = 0.05
    no_trade_threshold: float = 0.01
    cost_bps: float = 25.0
    borrow_rate: float = 0.0075


@dataclass(frozen=True)
class Settings:
    """Parameters shared by all scenarios."""

    liquidity: Liquidity = field(default_factory=Liquidity)
    ewma_window_days: int = 312
    ewma_seed: int = 20
    min_ols_pairs: int = 50
    min_ic_months: int = 12
    constraint_tolerance: float = 0.02
    country: str = "United States"
    risk_free_rate: float | None = None  # None: the country's average rate
    turnover_drift: str = "coming"


# The scenario set.
EXCLUDED_FACTORS = ("value", "quality", "momentum", "low_vol")
COST_VARIANTS = (
    ("cost_frictionless", 0.0, 0.0),
    ("cost_low", 10.0, 0.0075),
    ("cost_high", 50.0, 0.0075),
)
PARAMETER_VARIANTS = (
    ("sens_sel_0.05", "selection_threshold", 0.05),
    ("sens_sel_0.15", "selection_threshold", 0.15),
    ("sens_sel_0.20", "selection_threshold", 0.20),
    ("sens_ic_24", "ic_lookback_months", 24),
    ("sens_ic_48", "ic_lookback_months", 48),
    ("sens_ic_60", "ic_lookback_months", 60),
    ("sens_ewma_0.90", "ewma_lambda", 0.90),
    ("sens_ewma_0.92", "ewma_lambda", 0.92),
    ("sens_ewma_0.97", "ewma_lambda", 0.97),
    ("sens_notrade_0.005", "no_trade_threshold", 0.005),
    ("sens_notrade_0.015", "no_trade_threshold", 0.015),
    ("sens_notrade_0.020", "no_trade_threshold", 0.020),
    ("sens_buffer_none", "buffer_exit_threshold", 0.10),
    ("sens_buffer_0.15", "buffer_exit_threshold", 0.15),
    ("sens_buffer_0.25", "buffer_exit_threshold", 0.25),
)

RULES_SCHEMA = (
    "scenario_id string, ic_lookback_months int, excluded_factor string, selection_threshold double, "
    "buffer_exit_threshold double, buffer_max_months int, ewma_lambda double, aum double, "
    "liquidity_cap_pct double, no_trade_threshold double, cost_bps double, borrow_rate double"
)


def override(base: Rules, scenario_id: str, **changes) -> Rules:
    """A scenario that differs from ``base`` in the named parameters."""
    return replace(base, scenario_id=scenario_id, **changes)


def portfolio_scenarios(base: Rules = Rules()) -> list[Rules]:
    """Baseline, factor exclusions and one-at-a-time parameter variants (20 runs)."""
    return [
        base,
        *[override(base, f"excl_{f}", excluded_factor=f) for f in EXCLUDED_FACTORS],
        *[override(base, name, **{parameter: value}) for name, parameter, value in PARAMETER_VARIANTS],
    ]


def rules_table(spark: SparkSession, scenarios: list[Rules]) -> DataFrame:
    rows = [tuple(vars(s)[c.split()[0]] for c in RULES_SCHEMA.split(", ")) for s in scenarios]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def cost_table(spark: SparkSession, scenarios: list[Rules]) -> DataFrame:
    """Costs of every reported scenario: each on its own positions, and the cost
    variants on those of the baseline."""
    rows = [(s.scenario_id, s.scenario_id, s.cost_bps, s.borrow_rate) for s in scenarios]
    rows += [(name, "baseline", bps, borrow) for name, bps, borrow in COST_VARIANTS]
    return spark.createDataFrame(
        rows, "scenario_id string, base_scenario string, cost_bps double, borrow_rate double"
    )


def pending(rules: DataFrame, finished: DataFrame) -> DataFrame:
    """Scenarios without a stored summary yet."""
    return rules.join(finished.select("scenario_id"), "scenario_id", "left_anti")


def parameter_map(spark: SparkSession) -> DataFrame:
    """(parameter, value, scenario_id): six parameters with four values each."""
    base = Rules()
    rows = [(p, float(v), s) for s, p, v in PARAMETER_VARIANTS] + [("cost_bps", b, s) for s, b, _ in COST_VARIANTS]
    for p in dict.fromkeys(r[0] for r in list(rows)):
        rows.append((p, float(getattr(base, p)), "baseline"))
    return spark.createDataFrame(rows, "parameter string, value double, scenario_id string")
