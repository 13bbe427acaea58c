"""Stateful, time-aware operators: micro-batches, lifetimes, refusals, adaptive rates.

Each has a batch form and, where it keeps state over time, a streaming form that
gives the same rows; the tests hold them against each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import scratch_path

DAY = 86_400
#: Lifetimes of a positive and a negative answer, in seconds.
POSITIVE, NEGATIVE = 30 * DAY, 2 * DAY


def micro_batches(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """(start, event_type, n, value): events of one kind gathered for a time."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    return events.groupBy(start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def _seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def lifetimes(events: DataFrame, key: str = "user_id", positive: int = POSITIVE, negative: int = NEGATIVE) -> DataFrame:
    """Each event with ``hit``: whether the answer stored by the key's event before is
    still alive (errors live shorter)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    age = _seconds() - F.lag(_seconds()).over(w)
    life = F.when(F.lag("event_type").over(w) == "error", negative).otherwise(positive)
    return events.withColumn("hit", F.coalesce(age <= life, F.lit(False)))


def refusal_runs(events: DataFrame, key: str = "user_id", kind: str = "error", least: int = 2) -> DataFrame:
    """(key, start, length): runs of ``least`` or more refusals in a row."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    bad = F.col("event_type") == kind
    marked = events.withColumn("__r", F.row_number().over(w)).filter(bad).withColumn("__i", F.col("__r") - F.row_number().over(w))
    return marked.groupBy(key, "__i").agg(F.min("ts").alias("start"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("__i")


def adaptive_rates(events: DataFrame, key: str = "user_id", kind: str = "error", top: float = 8.0) -> DataFrame:
    """(event_id, rate): the rate after each event: halved by a refusal (an eighth of the top at
    least, 0.2 at least), a tenth more after any other, up to the top.

    A key's events pass through one task in order, a row at a time."""

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rate = None, top
        for pdf in parts:
            rows = []
            for k, e, t in zip(pdf[key].tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True):
                if k != now:
                    now, rate = k, top
                rate = max(rate / 2, top / 8, 0.2) if t == kind else min(rate * 1.1, top)
                rows.append((e, round(rate, 6)))
            yield pd.DataFrame(rows, columns=["event_id", "rate"])

    ready = events.select(key, "ts", "event_id", "event_type").repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return ready.select(key, "event_id", "event_type").mapInPandas(op, "event_id long, rate double")


def latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts): the latest event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("x")).select(key, "x.event_id", "x.ts")


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream over ``path`` (a glob)."""
    return spark.readStream.schema(schema).parquet(path)


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder and read it.

    Progress and offsets are in a checkpoint beside it, so a run that is
    stopped goes on where it was."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    query = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def merged_latest(df: DataFrame, name: str, key: str = "user_id") -> DataFrame:
    """The latest event of each key of a stream, kept up to date batch by batch
    (the store is read, merged with the batch's latest and written anew)."""
    spark = df.sparkSession
    root = scratch_path(spark, name)

    def merge(batch: DataFrame, n: int) -> None:
        own = latest(batch, key)
        old = spark.read.parquet(f"{root}/{n - 1}") if n else None
        both = own if old is None else own.unionByName(old)
        both.groupBy(key).agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("x")).select(key, "x.*").write.mode("overwrite").parquet(f"{root}/{n}")

    query = df.writeStream.foreachBatch(merge).option("checkpointLocation", root + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.parquet(f"{root}/{last['batchId'] if last else 0}")
