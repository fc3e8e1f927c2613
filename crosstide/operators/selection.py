"""Buffered decile selection: rank inside sectors, then windows over each symbol's dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosstide.operators.ranking import rank_pct

# The stored states.
LONG_CORE, LONG_BUFFER = "long_core", "long_buffer"
SHORT_CORE, SHORT_BUFFER = "short_core", "short_buffer"
NOT_SELECTED = "not_selected"
STATUSES = (LONG_CORE, LONG_BUFFER, SHORT_CORE, SHORT_BUFFER, NOT_SELECTED)

def sector_ranks(composites: DataFrame, universe: DataFrame) -> DataFrame:
    """Percentile rank inside (scenario, date, sector); names without sector drop out."""
    placed = composites.where(F.col("composite_score").isNotNull()).join(
        universe.select("symbol", "sector").where(F.col("sector").isNotNull()), "symbol"
    )
    return rank_pct(placed, ["scenario_id", "rebalance_date", "sector"], "composite_score", "percentile_rank")


def _dates_in_order(df: DataFrame) -> DataFrame:
    """(scenario_id, rebalance_date, ord): consecutive numbers of a scenario's dates."""
    dates = df.groupBy("scenario_id").agg(F.array_sort(F.collect_set("rebalance_date")).alias("dates"))
    return dates.select("scenario_id", F.posexplode("dates").alias("ord", "rebalance_date"))


def _zone(rank: Column, threshold: Column, exit_at: Column) -> Column:
    """Where a rank lies between the entry and exit thresholds of both sides."""
    return (
        F.when(rank >= 1.0 - threshold, "top")
        .when(rank >= 1.0 - exit_at, "upper")
        .when(rank <= threshold, "bottom")
        .when(rank <= exit_at, "lower")
        .otherwise("middle")
    )


def select_names(ranked: DataFrame, rules: DataFrame) -> DataFrame:
    """Selection status of every ranked name on every date, all scenarios at once.

    ``rules`` has scenario_id, selection_threshold, buffer_exit_threshold and
    buffer_max_months.  Top and bottom rows are core, whatever came before.  An
    upper row stays long only in a run of upper rows that directly follows a top
    row, while its place k in the run is below the patience, and exits by timer
    at k = patience; lower rows mirror this for shorts.  A date without a row
    ends a run.  So windows over one (scenario, symbol), sorted once, say it all.
    """
    limits = rules.select("scenario_id", "selection_threshold", "buffer_exit_threshold", "buffer_max_months")
    zone = _zone(F.col("percentile_rank"), F.col("selection_threshold"), F.col("buffer_exit_threshold"))
    rows = ranked.join(_dates_in_order(ranked), ["scenario_id", "rebalance_date"]).join(limits, "scenario_id").withColumn("zone", zone)
    order = W.partitionBy("scenario_id", "symbol").orderBy("ord")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)

    def before(column: str) -> Column:
        """The value at the date directly before, null if the name had no row there."""
        return F.when(F.lag("ord").over(order) == F.col("ord") - 1, F.lag(column).over(order))

    def latest(condition: Column, value: Column) -> Column:
        return F.last(F.when(condition, value), ignorenulls=True).over(so_far)

    rows = rows.withColumn("_came_from", before("zone"))
    new_run = ~F.col("zone").eqNullSafe(F.col("_came_from"))
    rows = rows.withColumn("_k", F.col("ord") - latest(new_run, F.col("ord")) + 1)
    rows = rows.withColumn("_from", latest(new_run, F.coalesce("_came_from", F.lit("none"))))
    long_run = (F.col("zone") == "upper") & (F.col("_from") == "top")
    short_run = (F.col("zone") == "lower") & (F.col("_from") == "bottom")
    stays = F.col("_k") < F.col("buffer_max_months")
    status = (
        F.when(F.col("zone") == "top", LONG_CORE)
        .when(F.col("zone") == "bottom", SHORT_CORE)
        .when(long_run & stays, LONG_BUFFER)
        .when(short_run & stays, SHORT_BUFFER)
        .otherwise(NOT_SELECTED)
    )
    rows = rows.withColumn("status", status).withColumn("_side", _side("status"))
    rows = rows.withColumn("_was", before("_side"))
    entered = F.col("_side").isNotNull() & ~F.col("_side").eqNullSafe(F.col("_was"))
    out = F.col("status") == NOT_SELECTED
    timed = ((F.col("zone") == "upper") & (F.col("_was") == "long")) | ((F.col("zone") == "lower") & (F.col("_was") == "short"))
    return rows.select(
        "scenario_id",
        "symbol",
        "ord",
        "rebalance_date",
        "sector",
        "composite_score",
        "percentile_rank",
        "status",
        F.when(F.col("status").isin(LONG_BUFFER, SHORT_BUFFER), F.col("_k")).otherwise(0).cast("int").alias("buffer_months_count"),
        F.when(~out, latest(entered, F.col("rebalance_date"))).alias("entry_date"),
        F.when(out & timed, "timer_exit").when(out & F.col("_was").isNotNull(), "hard_stop").alias("exit_reason"),
    )


def _side(status: str) -> Column:
    """long or short; null for a name that is not held."""
    return F.when(F.col(status).isin(LONG_CORE, LONG_BUFFER), "long").when(F.col(status).isin(SHORT_CORE, SHORT_BUFFER), "short")


def selected(selection: DataFrame) -> DataFrame:
    """Names held, with their side."""
    side = F.when(F.col("status").isin(LONG_CORE, LONG_BUFFER), "long").otherwise("short")
    return selection.where(F.col("status") != NOT_SELECTED).withColumn("direction", side)


def status_changes(selection: DataFrame) -> DataFrame:
    """Counts per scenario and date: each status, new entries, exits by side and reason.

    An exit is a name that was held at the previous date and is not any more,
    so its side is the one it had there.
    """
    order = W.partitionBy("scenario_id", "symbol").orderBy("rebalance_date")
    known = selection.withColumn("_was", F.lag(_side("status")).over(order))
    entered, left = F.col("entry_date") == F.col("rebalance_date"), F.col("exit_reason").isNotNull()
    return known.groupBy("scenario_id", "rebalance_date").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        *[F.count_if(entered & (_side("status") == side)).alias(f"new_{side}") for side in ("long", "short")],
        F.count_if(left).alias("exits"),
        *[F.count_if(left & (F.col("_was") == side)).alias(f"{side}_exits") for side in ("long", "short")],
        F.count_if(F.col("exit_reason") == "timer_exit").alias("timer_exits"),
        F.count_if(F.col("exit_reason") == "hard_stop").alias("hard_stops"),
    )
