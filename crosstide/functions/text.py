"""Display text: percentages, numbers, dates and scenario labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels.
MISSING = "-"
SCENARIO_LABELS = {
    "baseline": "Baseline (default parameters)",
    "cost_frictionless": "Cost: Frictionless (0 bps)",
    "cost_low": "Cost: Low (10 bps)",
    "cost_high": "Cost: High (50 bps)",
    "excl_value": "Exclude Value factor",
    "excl_quality": "Exclude Quality factor",
    "excl_momentum": "Exclude Momentum factor",
    "excl_low_vol": "Exclude Low Volatility factor",
}
PARAMETER_LABELS = {
    "sel": "selection threshold",
    "ic": "IC lookback (months)",
    "ewma": "EWMA lambda",
    "notrade": "no-trade threshold",
    "buffer": "buffer exit threshold",
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _fixed(col, places: int) -> Column:
    return F.format_string(f"%.{places}f", _c(col))


def _or_missing(shown: Column) -> Column:
    return F.coalesce(shown, F.lit(MISSING))


def _present(col, shown: Column) -> Column:
    return _or_missing(F.when(_c(col).isNotNull() & ~F.isnan(_c(col)), shown))


def percent(col, places: int = 2, signed: bool = False) -> Column:
    shown = F.concat(_fixed(_c(col) * 100, places), F.lit("%"))
    if signed:
        shown = F.concat(F.when(_c(col) > 0, "+").otherwise(""), shown)
    return _present(col, shown)


def number(col, places: int = 3, signed: bool = False) -> Column:
    shown = _fixed(col, places)
    if signed:
        shown = F.concat(F.when(_c(col) > 0, "+").otherwise(""), shown)
    return _present(col, shown)


def compact(col) -> Column:
    """1500000 -> '1.5M', 432 -> '432', 0.5 -> '0.50'."""
    v, size = _c(col), F.abs(_c(col))
    shown = (
        F.when(size >= 1e9, F.concat(_fixed(v / 1e9, 1), F.lit("B")))
        .when(size >= 1e6, F.concat(_fixed(v / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit("K")))
        .when(size >= 1, _fixed(v, 0))
        .otherwise(_fixed(v, 2))
    )
    return _present(col, shown)


def month_text(col) -> Column:
    return _or_missing(F.date_format(_c(col), "MMM yyyy"))


def span_text(start, end) -> Column:
    return F.concat(month_text(start), F.lit(" - "), month_text(end))


def scenario_label(col) -> Column:
    """Readable name of a scenario; 'sens_<parameter>_<value>' is taken apart."""
    s = _c(col)
    named = F.create_map(*[F.lit(v) for kv in SCENARIO_LABELS.items() for v in kv])
    short = F.create_map(*[F.lit(v) for kv in PARAMETER_LABELS.items() for v in kv])
    parameter = F.regexp_extract(s, "^sens_([^_]+)_(.+)$", 1)
    value = F.regexp_extract(s, "^sens_([^_]+)_(.+)$", 2)
    parsed = F.when(
        parameter != "",
        F.concat(
            F.lit("Sensitivity: "), F.coalesce(F.try_element_at(short, parameter), parameter), F.lit(" = "), value
        ),
    )
    return F.coalesce(F.try_element_at(named, s), parsed, s)
