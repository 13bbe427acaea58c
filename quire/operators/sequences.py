"""Ordered-scan operators: islands, gaps, numbering, carry-forward, precision groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """(keys, value, start, length): runs of ``least`` or more equal values in a row.

    ``order[0]`` numbers the rows of a key; a null value breaks a run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = Window.partitionBy(*keys, value).orderBy(*order)
    marked = df.withColumn("__r", F.row_number().over(w)).filter(F.col(value).isNotNull()).withColumn("__i", F.col("__r") - F.row_number().over(v))
    out = marked.groupBy(*keys, value, "__i").agg(F.min(order[0]).alias("start"), F.count("*").alias("length"))
    return out.filter(F.col("length") >= least).drop("__i")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the last value that isn't null so far (as-of state)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, True).over(w))


def number_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, missing): the numbers left out between the numbers of each key."""
    w = Window.partitionBy(*keys).orderBy(number)
    nexts = df.select(*keys, number).distinct().withColumn("__next", F.lead(number).over(w)).filter(F.col("__next") - F.col(number) > 1)
    return nexts.select(*keys, F.explode(F.sequence(F.col(number) + 1, F.col("__next") - 1)).alias("missing"))


def numbering_problems(headings: DataFrame, deepest: int = 3) -> DataFrame:
    """(doc_id, page, line_no, numbering, problem) of section numbers: too deep, no
    parent before it, not starting at 1, gap to the sibling before."""
    parts = F.split("numbering", r"\.")
    h = headings.select("doc_id", "page", "line_no", "numbering", "depth", F.when(F.col("depth") > 1, F.array_join(F.slice(parts, 1, F.col("depth") - 1), ".")).otherwise("").alias("parent"), F.element_at(parts, -1).try_cast("int").alias("last"))
    w = Window.partitionBy("doc_id", "parent").orderBy("page", "line_no")
    sib = h.withColumn("before", F.lag("last").over(w))
    at = h.select("doc_id", F.col("numbering").alias("parent"), F.struct("page", "line_no").alias("at")).groupBy("doc_id", "parent").agg(F.min("at").alias("at"))
    known = sib.join(at, ["doc_id", "parent"], "left").withColumn("has", F.coalesce(F.col("at") < F.struct("page", "line_no"), F.lit(False)))
    problem = (
        F.when(F.col("depth") > deepest, "too deep")
        .when((F.col("depth") > 1) & ~F.col("has"), "no parent")
        .when(F.col("before").isNull() & (F.col("last") != 1), "does not start at 1")
        .when(F.col("last") - F.col("before") > 1, "gap")
    )
    return known.withColumn("problem", problem).filter("problem IS NOT NULL").select("doc_id", "page", "line_no", "numbering", "problem")


def precision_groups(numbers: DataFrame, keys: list[str], number: str, least: int = 2) -> DataFrame:
    """(keys, places, n, low, high): decimal places used in a key's numbers (text
    column ``number``), where two neighbouring usages overlap in range."""
    places = F.when(F.col(number).contains("."), F.length(F.split(number, r"\.")[1])).otherwise(0)
    g = numbers.groupBy(*keys, places.alias("places")).agg(F.count("*").alias("n"), F.min(F.col(number).cast("double")).alias("low"), F.max(F.col(number).cast("double")).alias("high")).filter(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy("low", "places")
    near = g.withColumn("__lo", F.lead("low").over(w)).withColumn("__hi", F.lag("high").over(w))
    return near.filter((F.col("__lo") <= F.col("high")) | (F.col("__hi") >= F.col("low"))).drop("__lo", "__hi")
