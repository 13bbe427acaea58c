"""Queries of the time-aware operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.querybook import book
from quire.sources.tables import table
from quire.streaming import events as E

QUERIES, ORACLE, add = book()


_BATCHES = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


@add("micro_batches", _BATCHES)
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    return E.micro_batches(table(spark, d, "events"))


_SEC = "epoch_us(ts) / 1e6"


@add("ttl_cache", f"SELECT event_id, coalesce({_SEC} - lag({_SEC}) OVER w <= CASE WHEN lag(event_type) OVER w = 'error' THEN {E.NEGATIVE // 100} ELSE {E.POSITIVE // 100} END, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    return E.lifetimes(table(spark, d, "events"), positive=E.POSITIVE // 100, negative=E.NEGATIVE // 100).select("event_id", "hit")


@add("refusal_runs", "SELECT user_id, min(ts) AS start, count(*) AS length FROM (SELECT *, r - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE event_type = 'error') GROUP BY user_id, i HAVING count(*) >= 2")
def refusal_runs(spark: SparkSession, d: str) -> DataFrame:
    return E.refusal_runs(table(spark, d, "events"))


@add("adaptive_rates")
def adaptive_rates(spark: SparkSession, d: str) -> DataFrame:
    return E.adaptive_rates(table(spark, d, "events"))


@add("latest_events", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return E.stream(spark, f"{d.rstrip('/')}/events.parque[t]", table(spark, d, "events").schema)


@add("stream_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each key by a stream with a merged store."""
    return E.merged_latest(_stream(spark, d), "latest")


@add("stream_windows")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts with a watermark: windows that the watermark has passed."""
    s = _stream(spark, d).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour")
    g = s.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return E.run_to_end(g.select(F.col("w.start").alias("start"), "event_type", "n"), "windows")


@add("stream_distinct_users", "SELECT DISTINCT user_id FROM events")
def stream_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """Keys that arrive, once each while their state lives."""
    s = _stream(spark, d).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "3650 days")
    return E.run_to_end(s.dropDuplicatesWithinWatermark(["user_id"]).select("user_id"), "users")
