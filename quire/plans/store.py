"""Findings store, run listing, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(findings: DataFrame, path: str, run_id: str) -> None:
    """Append a run's findings, partitioned by run."""
    findings.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def load(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each paper's path (ties: the smaller id)."""
    order = Window.partitionBy("path").orderBy(F.desc("saved_at"), "run_id")
    return runs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def newest(runs: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` newest runs, the listing's feature."""
    return runs.orderBy(F.desc("saved_at"), "run_id").limit(k)


def pruned(runs: DataFrame, keep: int = 50) -> DataFrame:
    """The runs that a prune removes: all but each path's ``keep`` newest."""
    order = Window.partitionBy("path").orderBy(F.desc("saved_at"), "run_id")
    return runs.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") > keep).drop("__n")


def resolve(runs: DataFrame, target: str) -> DataFrame:
    """Runs named by id, by path, by file name, or the newest for "latest"."""
    if target == "latest":
        return newest(runs, 1)
    name = F.element_at(F.split("path", "/"), -1)
    return runs.filter((F.col("run_id") == target) | (F.col("path") == target) | (name == target))


def json_lines(findings: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON object a finding, null fields left out."""
    return findings.select("doc_id", F.to_json(F.struct(*[c for c in findings.columns if c != "doc_id"])).alias("value"))


_MARK = {"error": "✗", "warning": "!", "pass": "✓", "skipped": "–", "unverifiable": "?"}


def markdown(findings: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, markdown): a document's report in order of severity; ``most`` lines a check."""
    from quire.plans.config import SEVERITIES

    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    w = Window.partitionBy("doc_id", "check_id", "severity").orderBy("page", "message")
    few = findings.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most)
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in _MARK.items() for x in kv]), F.col("severity"))
    line = F.concat(F.lit("- "), mark, F.lit(" **"), F.col("title"), F.lit("**: "), F.col("message"))
    rows = few.select("doc_id", F.struct(rank.alias("r"), F.col("check_id"), F.col("__k"), line.alias("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("doc_id", F.array_join("xs.line", "\n").alias("markdown"))


def html(findings: DataFrame) -> DataFrame:
    """(doc_id, html): the report as an escaped, self-contained table."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr><td>"), F.col("severity"), F.lit("</td><td>"), esc(F.col("title")), F.lit("</td><td>"), esc(F.col("message")), F.lit("</td></tr>"))
    g = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("severity", "check_id", "message", row.alias("row")))).alias("rows"))
    return g.select("doc_id", F.concat(F.lit("<!doctype html><meta charset=utf-8><table>"), F.array_join("rows.row", ""), F.lit("</table>")).alias("html"))
