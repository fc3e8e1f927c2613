"""The keep-latest stream against the batch operator."""

import datetime as dt
import random

import pytest

from crosstide.operators.timeline import latest_by
from crosstide.sources import commits
from crosstide.streaming import latest

SCHEMA = "symbol string, day date, at timestamp, seq long, price double"
KEYS, ORDER = ["symbol", "day"], ["at", "seq"]
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", latest.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drawn(rng, n):
    rows = []
    for seq in range(n):
        at = START + dt.timedelta(minutes=rng.randint(0, 600))
        rows.append((rng.choice(["a", "b", "c", None]), dt.date(2024, 1, rng.randint(1, 3)), at, seq, rng.choice([None, 1.5, 2.5])))
    return rows


def feed(spark, place, batches, delay="1 day", keep_ms=86_400_000):
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(schema).parquet(f"{place}/in")
        out = latest.latest_per_key(stream, KEYS, ORDER, "at", delay, keep_ms)
        latest.store_latest(out, f"{place}/out", f"{place}/cp", "prices").awaitTermination()
    return schema


def as_rows(df):
    return sorted(map(tuple, df.select("symbol", "day", "at", "seq", "price").collect()), key=str)


def test_out_of_order_files_equal_the_batch(rocks, tmp_path):
    rng = random.Random(6)
    rows = drawn(rng, 120)
    batches = [rows[k::4] for k in (2, 0, 3, 1)]
    schema = feed(rocks, str(tmp_path), batches)
    got = latest.read_latest(rocks, f"{tmp_path}/out", schema, KEYS, ORDER)
    assert as_rows(got) == as_rows(latest_by(rocks.createDataFrame(rows, SCHEMA), KEYS, ORDER))
    given_out = commits.read(rocks, f"{tmp_path}/out", schema)
    assert given_out.count() <= 4 * 12  # one row for each key and micro-batch at most


def test_replayed_batches_add_nothing(rocks, tmp_path):
    rows = drawn(random.Random(7), 30)
    schema = feed(rocks, str(tmp_path), [rows])
    before = commits.read(rocks, f"{tmp_path}/out", schema).count()
    # the same micro-batches again, as after a loss of the checkpoint
    stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
    again = latest.latest_per_key(stream, KEYS, ORDER, "at")
    latest.store_latest(again, f"{tmp_path}/out", f"{tmp_path}/cp2", "prices").awaitTermination()
    assert commits.read(rocks, f"{tmp_path}/out", schema).count() == before


def test_timers_release_keys_and_late_rows_stay_out(rocks, tmp_path):
    def row(symbol, hours, seq, price):
        return (symbol, dt.date(2024, 1, 1), START + dt.timedelta(hours=hours), seq, price)

    batches = [[row("a", 0, 1, 1.0)], [row("b", 500, 2, 2.0)], [row("b", 501, 3, 3.0)], [row("a", 1, 4, 9.0)], [row("a", 502, 5, 5.0)], [(None, None, None, 6, 6.0)]]
    schema = feed(rocks, str(tmp_path), batches, "1 hour", 3_600_000)
    got = as_rows(latest.read_latest(rocks, f"{tmp_path}/out", schema, KEYS, ORDER))
    assert [(r[0], r[4]) for r in got] == [("a", 5.0), ("b", 3.0)]
    assert 9.0 not in [r.price for r in commits.read(rocks, f"{tmp_path}/out", schema).collect()]
