"""Time-aware operators: streams give what batches give."""

import datetime as dt
import random

import pytest

from quire.streaming import events as E

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    return [(i, t + dt.timedelta(minutes=rng.randint(0, 3000)), rng.randint(1, 7), rng.choice(["error", "view", "click"]), rng.random()) for i in range(300)]


def test_stream_latest_equals_batch(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        df.filter(f"event_id % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = sorted(map(tuple, E.merged_latest(s, "t").collect()))
    assert got == sorted(map(tuple, E.latest(df).collect()))


def test_rates_equal_a_loop(spark, rows):
    got = {r.event_id: r.rate for r in E.adaptive_rates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    now, want = {}, {}
    for e, ts, u, kind, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        now[u] = max(now.get(u, 8.0) / 2, 1.0) if kind == "error" else min(now.get(u, 8.0) * 1.1, 8.0)
        want[e] = round(now[u], 6)
    assert got == want


def test_refusals_and_lifetimes(spark):
    t = dt.datetime(2024, 1, 1)
    kinds = ["error", "error", "view", "error", "error", "error"]
    df = spark.createDataFrame([(i, t + dt.timedelta(days=3 * i), 1, k, 1.0) for i, k in enumerate(kinds)], SCHEMA)
    assert sorted(r.length for r in E.refusal_runs(df).collect()) == [2, 3]
    assert [r.hit for r in E.lifetimes(df).orderBy("event_id").collect()] == [False, False, False, True, False, False]
    assert E.refusal_runs(df.limit(0)).count() == 0 and E.micro_batches(df).count() == 6
