"""Stored stages: a run computes only the months whose inputs or rules have changed.

A stage reads sources and earlier stages, each over some months back, and stores
its rows by month.  What it read is known by content: the rows of a month of an
input have one fingerprint, whatever their order, and the fingerprint of a (stage,
month) is made of those of all it reads and of the stage's rules.  The log keeps
the fingerprints under which months were stored.  A later run takes a month up
again if its fingerprint is another one, so late rows reach exactly the months
that look at them, and a stage whose input came out as before is not run.

Rows are committed before their fingerprint is: a run that breaks off in between
computes that month again, and stores the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.sources import commits
from crosstide.sources.tables import KEY_DATES, partition_column, read_table, to_table, with_partition

LOG = StructType().add("stage", "string").add("month", "string").add("fingerprint", "string")


@dataclass(frozen=True)
class Source:
    """An input frame; without a date column it counts as a whole."""

    rows: DataFrame
    date: str | None = None


@dataclass(frozen=True)
class Read:
    """An input of a stage: ``back`` months before the computed one, or all of them (None)."""

    name: str
    back: int | None = 0


@dataclass(frozen=True)
class Stage:
    """``compute`` gets the inputs, cut to what the wanted months read, and may return rows of other months too."""

    table: str
    reads: tuple[Read, ...]
    compute: Callable[[dict[str, DataFrame]], DataFrame]
    rules: str = ""


def _number(month: str) -> int:
    return int(month[:4]) * 12 + int(month[5:])


def fingerprints(rows: DataFrame, date: str | None) -> dict[str | None, str]:
    """Content by month: count and sums of two row hashes, so neither order nor layout matters.

    The thirds of a hash are summed as whole numbers (exact below 2 ** 39 rows a month).
    """
    columns = sorted(rows.columns)
    low = F.lit((1 << 24) - 1)
    thirds = [
        f.alias(f"{name}{k}")
        for name, hashed in (("a", F.xxhash64(*columns, F.lit(1))), ("b", F.xxhash64(*columns, F.lit(2))))
        for k, f in enumerate((F.shiftright(hashed, 48), F.shiftright(hashed, 24).bitwiseAND(low), hashed.bitwiseAND(low)))
    ]
    number = (F.year(date) * 12 + F.month(date) - 1) if date else F.lit(None).cast("int")
    sums = [F.sum(x).alias(x) for x in ("a0", "a1", "a2", "b0", "b1", "b2")]
    of = rows.select(number.alias("number"), *thirds).groupBy("number").agg(F.count(F.lit(1)).alias("n"), *sums)
    found = of.collect()  # one row for each month
    return {
        None if r.number is None else f"{r.number // 12:04d}-{r.number % 12 + 1:02d}": ":".join(map(str, r[1:]))
        for r in found
    }


def _fingerprint(stage: Stage, month: str, inputs: dict[str, dict[str | None, str]]) -> str:
    digest = hashlib.sha256(f"{stage.table}\n{stage.rules}\n".encode())
    at = _number(month)
    for read in stage.reads:
        for key, value in sorted(inputs[read.name].items(), key=str):
            if key is None or (_number(key) <= at and (read.back is None or _number(key) >= at - read.back)):
                digest.update(f"{read.name} {key} {value}\n".encode())
    return digest.hexdigest()


def _cut(rows: DataFrame, date: str | None, months: list[str], back: int | None) -> DataFrame:
    """The months of an input that the wanted months read."""
    if not date:
        return rows
    number = F.year(date) * 12 + F.month(date)
    wanted = sorted(_number(m) for m in months)
    if back is None:
        return rows.where(number <= wanted[-1])
    return rows.where(number.isin(sorted({n - k for n in wanted for k in range(back + 1)})))


def run_stages(spark: SparkSession, location: str, sources: dict[str, Source], stages: Iterable[Stage], months: Iterable[str]) -> list[tuple[str, str]]:
    """Bring the stored tables of ``stages`` up to date for ``months`` (yyyy-MM): the (table, month) computed.

    Stages come after what they read.  A month without rows is stored as empty.
    """
    months, log, done = sorted(set(months)), f"{location}/_stages", []
    inputs = {name: fingerprints(s.rows, s.date) for name, s in sources.items()}
    frames = dict(sources)
    for stage in stages:
        if partition_column(stage.table) != "key_month":
            raise ValueError(f"{stage.table} is not laid out by month")
        known = {r.month: r.fingerprint for r in commits.read(spark, log, LOG, [stage.table]).collect()}
        now = {m: _fingerprint(stage, m, inputs) for m in months}
        pending = [m for m in months if known.get(m) != now[m]]
        if pending:
            cut = {r.name: _cut(frames[r.name].rows, frames[r.name].date, pending, r.back) for r in stage.reads}
            rows = with_partition(to_table(stage.compute(cut), stage.table), stage.table).where(F.col("key_month").isin(pending))
            commits.replace(rows, f"{location}/{stage.table}", "key_month", only_values=True, values=pending)
            entries = [(stage.table, m, f) for m, f in ({**known, **{m: now[m] for m in pending}}).items()]
            commits.replace(spark.createDataFrame(entries, LOG).coalesce(1), log, "stage", only_values=True)
            done += [(stage.table, m) for m in pending]
        stored = read_table(spark, location, stage.table)
        frames[stage.table] = Source(stored, KEY_DATES[stage.table])
        inputs[stage.table] = fingerprints(stored, KEY_DATES[stage.table])
    return done


def stored_rows(spark: SparkSession, location: str, table: str, months: list[str] | None = None) -> DataFrame:
    """Rows of a stage's table, of some months only if asked for; other folders are not read."""
    return read_table(spark, location, table, months)

