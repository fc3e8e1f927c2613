"""Session set-up and the two ways this package keeps an intermediate result.

``settle``      keeps a *small grouped summary* so that the planner sees its
                measured size before it chooses how to join it.
``materialize`` writes a *large intermediate* as a table into the shared folder
                of the cluster, which cuts its lineage and survives the loss of
                executors.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings for a single-machine session; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
    "spark.sql.ui.retainedExecutions": "20",
    "spark.ui.retainedJobs": "50",
    "spark.ui.retainedStages": "50",
}


def local_session(cores: str = "8", app: str = "crosstide", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch one in local runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="crosstide-"))
    return context.getCheckpointDir()


class ScratchTable:
    """An intermediate table in the shared folder, written in numbered steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _written.append(self.path)

    def write(self, df: DataFrame, step: int = 0) -> None:
        df.write.parquet(f"{self.path}/step={step}")

    def write_by(self, df: DataFrame, column: str) -> None:
        """All steps at once, numbered by a column."""
        df.withColumnRenamed(column, "step").write.partitionBy("step").parquet(self.path)

    def read(self, schema, step: int | None = None) -> DataFrame:
        """One step, or all of them."""
        if step is not None:
            return self.spark.read.schema(schema).parquet(f"{self.path}/step={step}")
        return self.spark.read.schema(schema).parquet(self.path).select(*[f.name for f in schema.fields])


def scratch_table(spark: SparkSession, name: str) -> ScratchTable:
    return ScratchTable(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back."""
    table = ScratchTable(df.sparkSession, name)
    df.write.parquet(table.path)
    return df.sparkSession.read.schema(df.schema).parquet(table.path)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that have ended.

    It does so when the driver collects its garbage. Right after a step its plan
    is still held by the report of its end, so the second time counts.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` as the end of a step: what the step has shuffled is deleted before the next one shuffles."""
    table = materialize(df, name)
    let_go(df.sparkSession)
    return table


_kept: list[DataFrame] = []
_written: list[str] = []


def keep(df: DataFrame) -> DataFrame:
    """Keep a frame that several steps read, in memory or on local disk.

    Lost parts are computed again, so the loss of an executor does no harm.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


def settle(summary: DataFrame) -> DataFrame:
    """Compute a grouped summary (one row for a scenario, date and sector at most) once and keep it.

    A kept frame reports its real size, so a later join is planned as a
    broadcast only below ``spark.sql.autoBroadcastJoinThreshold`` and as a
    skew-aware sort-merge join above it.  No broadcast hint is needed.
    """
    kept = keep(summary)
    kept.count()
    return kept


ROWS_A_TASK = 250_000  # of a few short columns


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of tasks for so many rows, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def in_tasks(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to a number of tasks that grows with the data; without one, as they are.

    Adaptive execution merges the tasks of an exchange by the bytes they read.  What
    a task makes of few bytes (windows, rows spread over dates) may be many times
    larger, so the number is given where it is known.
    """
    return df.repartition(tasks, *keys) if tasks else df


def release(spark: SparkSession | None = None) -> None:
    """End of a run: let go of kept frames and delete its intermediate tables.

    Call it when no frame of the run will be read again.
    """
    current = spark or SparkSession.getActiveSession()
    while _kept:
        frame = _kept.pop()
        if frame.sparkSession is current:  # a session that has ended took its frames along
            frame.unpersist()
    while _written and current:
        _delete(current, _written.pop())


@contextmanager
def last_table_stays(spark: SparkSession) -> Iterator[None]:
    """Lets go of all that is kept or written inside but the table written last, the only one that is read later."""
    kept, written = len(_kept), len(_written)
    yield
    for frame in _kept[kept:]:
        frame.unpersist()
    del _kept[kept:]
    for path in _written[written:-1]:
        _delete(spark, path)
    del _written[written:-1]
    let_go(spark)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
