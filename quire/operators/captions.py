"""Captions, statements and their extents from lines in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPTION = r"^\s*(Figure|Fig\.|Table|Algorithm|Listing)\s+([A-Z]?\.?\d+(?:\.\d+)*)\s*[:.]\s*(.*)$"


def captions(lines: DataFrame, most: int = 29, gap: float = 8.0) -> DataFrame:
    """(doc_id, page, line_no, kind, label, text): captions with the lines they run on over.

    A caption takes the lines after it on its page until another caption, an empty
    line, a vertical gap over ``gap`` points, or ``most`` lines; line numbers are left out."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    start = F.col("text").rlike(CAPTION)
    kept = lines.filter(~F.col("text").rlike(r"^\s*\d{1,4}\s*$"))
    marked = kept.withColumn("apart", F.col("y0") - F.lag("y1").over(page) > gap).withColumn("start", start)
    stop = F.col("start") | F.coalesce("apart", F.lit(False)) | (F.trim("text") == "")
    runs = marked.withColumn("run", F.sum(F.when(stop, 1).otherwise(0)).over(page))
    inside = runs.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page", "run").orderBy("line_no"))).withColumn("head", F.first("start").over(Window.partitionBy("doc_id", "page", "run").orderBy("line_no")))
    taken = inside.filter(F.col("head") & (F.col("k") <= most + 1))
    g = taken.groupBy("doc_id", "page", "run").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.trim(x["text"])), " ").alias("whole"))
    kind = F.regexp_replace(F.lower(F.regexp_extract("whole", CAPTION, 1)), r"^fig\.$", "figure")
    return g.select("doc_id", "page", "line_no", kind.alias("kind"), F.regexp_extract("whole", CAPTION, 2).alias("label"), F.regexp_extract("whole", CAPTION, 3).alias("text"))


def statements(lines: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """(doc_id, key, start, end): where statements stand, by a heading or a run-in head
    that is one of a key's labels (the first of several); each ends where the next begins."""
    pos = (F.col("page").cast("bigint") * 10_000 + F.col("line_no")).alias("pos")
    head = F.lower(F.regexp_extract("text", r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?([A-Za-z][A-Za-z ]{2,60}?)\s*(?:[.:—–]|$)", 1))
    key = None
    for k, names in labels.items():
        test = head.isin([n.lower() for n in names])
        key = F.when(test, k) if key is None else key.when(test, k)
    found = lines.select("doc_id", pos, key.alias("key")).filter("key IS NOT NULL")
    first = found.groupBy("doc_id", "key").agg(F.min("pos").alias("start"))
    return first.withColumn("end", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))
