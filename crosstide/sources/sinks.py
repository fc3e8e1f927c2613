"""Writing stored tables: appends, key-aware inserts, scenario replacement, deletes.

Every writer commits through the table's log (``commits``), so writers can be
used in turn and side by side: a row is visible when its commit is, and a key is
stored once whoever else inserts it.  Tables are laid out by
``tables.partition_column``; inserts by key read only the key columns of the
folders that the batch touches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.operators.timeline import latest_by
from crosstide.session import in_tasks, tasks_for
from crosstide.sources import commits
from crosstide.sources.tables import KEYS, SCENARIO_TABLES, SCHEMAS, conformed, partition_column, read_table, stored_schema, to_table, with_partition

ARRIVAL = "_arrival"  # order in which the rows of a batch came


def table_exists(spark: SparkSession, location: str, name: str) -> bool:
    return commits.exists(spark, f"{location}/{name}")


def write(df: DataFrame, location: str, name: str, if_exists: str = "append", batch: str | None = None) -> int:
    """Append, replace, or fail if the table is there.  Returns rows written.

    An appended batch with an id is written once, however often it is tried.
    """
    rows, root, column = with_partition(to_table(df, name), name), f"{location}/{name}", partition_column(name)
    if if_exists == "fail" and commits.exists(df.sparkSession, root):
        raise AnalysisException(f"table {name} is there already")
    if if_exists == "replace":
        return commits.replace(rows, root, column, only_values=False)
    return commits.append(rows, root, column, batch)


def absent_rows(incoming: DataFrame, existing: DataFrame, keys, tasks: int | None = None) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key.

    With an ``_arrival`` column the first arrival of a key is taken; without one
    the greatest row, so that the choice does not depend on the order of reading.
    With ``tasks`` both sides are dealt by key to so many.
    """
    if ARRIVAL in incoming.columns:
        unique = latest_by(incoming.withColumn("_order", -F.col(ARRIVAL)), keys, ["_order"]).drop("_order", ARRIVAL)
    else:
        rest = [c for c in incoming.columns if c not in keys]
        unique = latest_by(incoming, keys, rest) if rest else incoming.distinct()
    return in_tasks(unique, tasks, *keys).join(in_tasks(existing.select(*keys), tasks, *keys), list(keys), "left_anti")


def prepare_insert(df: DataFrame, location: str, name: str, batch: str | None = None) -> commits.Insert:
    """Write aside the rows of ``df`` whose business keys are not stored yet; ``commits.commit_insert`` ends it.

    ``df`` may carry ``_arrival`` (see ``absent_rows``).
    """
    spark, column = df.sparkSession, partition_column(name)
    incoming = to_table(df, name, also=(ARRIVAL,))
    values = tasks = None
    if column:  # as many values as the batch has months, years or scenarios
        held = with_partition(incoming, name).groupBy(F.col(column).cast("string").alias("value")).count().collect()
        values = [r[0] for r in held]
        before = commits.rows_of(spark, f"{location}/{name}", stored_schema(name), values)
        tasks = tasks_for(spark, max(sum(r[1] for r in held), before))
    return commits.prepare_insert(
        lambda stored: with_partition(absent_rows(incoming, conformed(stored, name), KEYS[name], tasks), name),
        values, spark, f"{location}/{name}", stored_schema(name), column, KEYS[name], batch,
    )


def insert_if_absent(df: DataFrame, location: str, name: str, batch: str | None = None) -> int:
    """Insert rows with new business keys; an existing key wins.  Returns rows added.

    A batch with an id that has been committed adds nothing.
    """
    return commits.commit_insert(df.sparkSession, prepare_insert(df, location, name, batch))


def insert_filings(df: DataFrame, location: str, arrival: str = "arrival") -> int:
    """Keep the last arrival of each filing key, then insert the new keys."""
    return insert_if_absent(latest_by(df, KEYS["financial_data"], [arrival]), location, "financial_data")


def replace_scenarios(df: DataFrame, location: str, name: str) -> None:
    """Replace all rows of the scenarios in ``df``; other scenarios stay."""
    if name not in SCENARIO_TABLES:
        raise ValueError(f"{name} has no scenarios")
    commits.replace(with_partition(to_table(df, name), name), f"{location}/{name}", partition_column(name), only_values=True)


def with_composite(scores: DataFrame, composite: DataFrame) -> DataFrame:
    """Factor scores with their composite attached; a missing or null one leaves what is there.

    Of several composites of a key the greatest is taken.
    """
    new = composite.groupBy("symbol", "score_date").agg(F.max("composite_score").alias("_new"))
    return (
        scores.join(new, ["symbol", "score_date"], "left")
        .withColumn("composite_score", F.coalesce("_new", "composite_score"))
        .select(*scores.columns)
    )


def update_composites(composite: DataFrame, location: str, batch: str | None = None) -> int:
    """Set ``composite_score`` of the stored factor scores by (symbol, score_date): folders written anew.

    Only the months that ``composite`` has are read and written.  Keys that are
    not stored are not added; a batch with an id that has been committed changes
    nothing.
    """
    spark, column = composite.sparkSession, partition_column("factor_scores")
    new = with_partition(composite.select(F.trim("symbol").alias("symbol"), "score_date", "composite_score"), "factor_scores")
    months = [r[0] for r in new.select(column).distinct().collect()]  # as many as the batch has months
    return commits.rewrite(
        lambda stored: with_partition(with_composite(conformed(stored, "factor_scores"), new), "factor_scores"),
        months, spark, f"{location}/factor_scores", stored_schema("factor_scores"), column, batch,
    )


def delete_stale_symbols(spark: SparkSession, location: str, universe: DataFrame) -> list[str]:
    """Delete rows of symbols outside ``universe`` from every table, landed data and control rows.

    A stored table gets a delete file with its stale symbols and keeps its
    folders; ``fold_stale`` writes the touched ones anew some time later.
    """
    known = universe.select("symbol").distinct()
    done = []
    for name, ddl in SCHEMAS.items():
        if name == "company_static" or "symbol string" not in ddl or not table_exists(spark, location, name):
            continue
        stored = commits.read(spark, f"{location}/{name}", stored_schema(name)).select("symbol").distinct()
        stale = stored.join(known, F.trim(stored["symbol"]) == known["symbol"], "left_anti")
        if commits.delete(stale, f"{location}/{name}", ("symbol",)):
            done.append(name)
    from crosstide.sources.control import forget_names

    return done + forget_names(spark, location, known)


def fold_stale(spark: SparkSession, location: str, name: str) -> int:
    """Write the folders of a table that hold deleted rows anew: folders written."""
    return commits.fold_deletes(spark, f"{location}/{name}", stored_schema(name), partition_column(name))


def table_counts(spark: SparkSession, location: str) -> DataFrame:
    """(table_name, rows) of every stored table; 0 where it is not there."""
    counts = None
    for name in SCHEMAS:
        if table_exists(spark, location, name):
            one = read_table(spark, location, name).agg(F.count(F.lit(1)).alias("rows"))
        else:
            one = spark.range(1).select(F.lit(0).cast("bigint").alias("rows"))
        one = one.select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def export_csv(df: DataFrame, path: str) -> None:
    """A report table as CSV files with a header, as many as its partitions."""
    df.write.mode("overwrite").csv(path, header=True)
