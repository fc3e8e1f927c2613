"""Landed datasets with a control table: freshness, load marks, audit and run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.sources import commits

CONTROL = (
    "name string, data_type string, fetched_at timestamp, rows bigint, source string, "
    "loaded boolean, loaded_at timestamp, event_at timestamp"
)


def land(df: DataFrame, location: str, data_type: str, source: str, at: Column, by: str = "symbol") -> None:
    """Append a dataset, clustered by name, and one control row per name.

    Each data type is a committed table, laid out by the month of landing, so
    the number of folders follows the calendar and not the universe.
    """
    month = F.date_format(at.cast("timestamp"), "yyyy-MM")
    landed = df.withColumn("landed_month", month).repartitionByRange(by).sortWithinPartitions(by)
    commits.append(landed, f"{location}/landed/{data_type}", "landed_month")
    control = (
        df.groupBy(F.col(by).alias("name"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            "name",
            F.lit(data_type).alias("data_type"),
            at.cast("timestamp").alias("fetched_at"),
            "rows",
            F.lit(source).alias("source"),
            F.lit(False).alias("loaded"),
            F.lit(None).cast("timestamp").alias("loaded_at"),
            at.cast("timestamp").alias("event_at"),
        )
    )
    control.write.mode("append").parquet(f"{location}/control")


def read_landed(spark: SparkSession, location: str, data_type: str) -> DataFrame:
    """All rows landed so far; the columns are those of the first landing."""
    root = f"{location}/landed/{data_type}"
    now = commits.head(spark, root)
    schema = spark.read.parquet(f"{root}/{now.parts[0].path}").schema
    return commits.read(spark, root, schema, at=now).drop("landed_month")


def read_control(spark: SparkSession, location: str) -> DataFrame:
    """Control rows; a swap that was cut off is ended first."""
    files, live = _folder(spark, f"{location}/control")
    if not files.exists(live):
        for entry in files.globStatus(_folder(spark, f"{location}/control.new-*")[1]) or []:
            if files.exists(_folder(spark, f"{entry.getPath()}/_SUCCESS")[1]):
                files.rename(entry.getPath(), live)
                break
    return spark.read.schema(CONTROL).parquet(f"{location}/control")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def forget_names(spark: SparkSession, location: str, known: DataFrame, by: str = "symbol") -> list[str]:
    """Take names outside ``known`` (symbol) out of landed data and control rows; returns what changed.

    Landed data get a delete file.  Control rows to keep are written aside and
    take the folder's place by two renames; ``read_control`` ends a swap that
    was cut off between them.
    """
    files, live = _folder(spark, f"{location}/control")
    if not files.exists(live):
        return []
    names = known.select(F.col("symbol").alias("name"))
    control = read_control(spark, location)
    stale = control.join(names, "name", "left_anti")
    done = []
    for data_type in sorted(r[0] for r in stale.select("data_type").distinct().collect()):
        gone = stale.where(F.col("data_type") == data_type).select(F.col("name").alias(by))
        commits.delete(gone, f"{location}/landed/{data_type}", (by,))
        done.append(f"landed/{data_type}")
    if done:
        mark = uuid.uuid4().hex
        new, old = (_folder(spark, f"{location}/control.{kind}-{mark}")[1] for kind in ("new", "old"))
        control.join(names, "name", "left_semi").write.parquet(new.toString())
        files.rename(live, old)
        files.rename(new, live)
        files.delete(old, True)
        done.append("control")
    return done


def mark_loaded(names: DataFrame, location: str, data_type: str, at: Column) -> None:
    """Append a load event for each name; the newest event is the current state."""
    spark = names.sparkSession
    current = current_state(read_control(spark, location))
    current.where(F.col("data_type") == data_type).join(names.select("name"), "name", "left_semi").select(
        "name", "data_type", "fetched_at", "rows", "source",
        F.lit(True).alias("loaded"), at.cast("timestamp").alias("loaded_at"), at.cast("timestamp").alias("event_at"),
    ).write.mode("append").parquet(f"{location}/control")


def current_state(control: DataFrame) -> DataFrame:
    from crosstide.operators.timeline import latest_by

    return latest_by(control, ["name", "data_type"], ["event_at", "loaded"])


def fresh(control: DataFrame, as_of: Column, ttl_days: int | None) -> DataFrame:
    """Names still usable: whole days since fetch within the limit.

    No limit never expires, and neither does a row without a readable time.
    """
    if ttl_days is None:
        return control
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("fetched_at")) / 86400)
    return control.where(F.col("fetched_at").isNull() | (age <= ttl_days))


def batch_audit(rows: DataFrame, data_type: str, date: str = "trade_date", by: str = "symbol") -> DataFrame:
    """Audit documents of a raw batch: rows and row count per symbol and year.

    Keys are unique per symbol and day, so a document holds at most a year of
    days; copies are folded before the rows are gathered.
    """
    rest = [c for c in rows.columns if c not in (by, date)]
    unique = rows.groupBy(by, date).agg(
        F.max(F.struct(*rest)).alias("row"), F.count(F.lit(1)).alias("copies")
    )
    return unique.groupBy(by, F.year(date).alias("year")).agg(
        F.lit(data_type).alias("data_type"),
        F.sum("copies").alias("row_count"),
        F.array_sort(F.collect_list(F.struct(date, "row.*"))).alias("rows"),
    )


def log_validation(gated: DataFrame, location: str, at: Column) -> None:
    """Append the validation verdicts (arrays of warnings and errors, map of stats)."""
    gated.withColumn("checked_at", at).write.mode("append").parquet(f"{location}/audit_validation")


def log_run(spark: SparkSession, location: str, **fields) -> None:
    """Append one JSON line for a run: id, task, times, stages, status, error."""
    columns = [F.lit(str(v) if v is not None else None).alias(k) for k, v in sorted(fields.items())]
    spark.range(1).select(*columns).write.mode("append").json(f"{location}/pipeline_runs")
