"""Queries of the layout operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.querybook import book
from quire.sources.projections import duck, projection
from quire.sources.tables import table

QUERIES, ORACLE, add = book()


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return L.delivered_once(table(spark, d, "spans"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "placed_spans")


# One delivery of each span, and the lines they make, in DuckDB.
SPANS = "(SELECT DISTINCT ON (doc_id, page, line_no, span_no) * FROM spans)"
_SEEN = "NOT (render_mode IN (3, 7) OR coalesce(opacity, 1.0) <= 0.01)"
_BOLD = "((coalesce(flags, 0) & 16) <> 0 OR coalesce(contains(lower(font), 'bold'), false))"
LINES = f"""(SELECT doc_id, page, line_no, string_agg(text, '' ORDER BY span_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
arg_max(size, (x1 - x0, -span_no)) AS size,
sum(CASE WHEN {_SEEN} AND {_BOLD} THEN x1 - x0 ELSE 0 END) > 0.6 * sum(CASE WHEN {_SEEN} THEN x1 - x0 ELSE 0 END) AS bold
FROM {SPANS} GROUP BY doc_id, page, line_no)"""
BODY = f"""(SELECT doc_id, value AS size FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) AS n FROM (
SELECT doc_id, round_even(size * 2, 0) / 2 AS value, sum(length(trim(text))) AS w, min((page, line_no, span_no)) AS first FROM {SPANS} WHERE length(trim(text)) >= 2 GROUP BY 1, 2)) WHERE n = 1)"""


@add("lines_of_spans", f"SELECT * FROM {LINES}")
def lines_of_spans(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(_spans(spark, d))


@add("body_lines", f"SELECT * FROM {LINES} WHERE regexp_matches(text, '[A-Za-z]') AND y0 >= 0.08 * 842.0 AND y1 <= (1 - 0.08) * 842.0")
def body_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.body_lines(L.lines(_spans(spark, d)))


@add("left_edge_histogram", f"SELECT doc_id, CAST(round_even(x0 / 2, 0) AS INTEGER) AS edge, count(*) AS n FROM {LINES} GROUP BY ALL")
def left_edge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return L.left_edges(L.lines(_spans(spark, d)))


@add("column_bands")
def column_bands(spark: SparkSession, d: str) -> DataFrame:
    return L.column_bands(L.body_lines(_page_lines(spark, d)))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_lines").dropDuplicates(["doc_id", "page", "line_no"])


@add("column_fit")
def column_fit(spark: SparkSession, d: str) -> DataFrame:
    line = L.body_lines(_page_lines(spark, d))
    return L.column_fit(line, L.column_bands(line))


@add(
    "reading_order",
    """SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN x0 >= 300 THEN 1 ELSE 0 END, round_even(y0, 1), x0, line_no) AS pos
    FROM (SELECT DISTINCT ON (doc_id, page, line_no) * FROM page_lines)""",
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(_page_lines(spark, d)).select("doc_id", "page", "line_no", F.col("pos").cast("bigint").alias("pos"))


@add("body_font_size", f"SELECT * FROM {BODY}")
def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    return L.body_font_size(_spans(spark, d))


@add(
    "dominant_font",
    f"""SELECT doc_id, font, round(w / whole, 6) AS share FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) AS n FROM (
    SELECT doc_id, font, sum(length(trim(text))) AS w, min((page, line_no, span_no)) AS first FROM {SPANS} WHERE font IS NOT NULL AND length(trim(text)) >= 1 GROUP BY 1, 2)) WHERE n = 1""",
)
def dominant_font(spark: SparkSession, d: str) -> DataFrame:
    return L.dominant_font(_spans(spark, d))


@add(
    "font_family_check",
    f"""SELECT doc_id, font, round(w / whole, 6) AS share, CASE WHEN w / whole < 0.35 THEN 'no main font' WHEN NOT regexp_matches(lower(font), 'nimbus|times|serif|termes') THEN 'unusual font' END AS reason
    FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) AS n FROM (
    SELECT doc_id, font, sum(length(trim(text))) AS w, min((page, line_no, span_no)) AS first FROM {duck("placed_spans")} WHERE font IS NOT NULL AND length(trim(text)) >= 1 GROUP BY 1, 2)) WHERE n = 1""",
)
def font_family_check(spark: SparkSession, d: str) -> DataFrame:
    top = L.dominant_font(_placed(spark, d))
    reason = F.when(F.col("share") < 0.35, "no main font").when(~F.lower("font").rlike("nimbus|times|serif|termes"), "unusual font")
    return top.withColumn("reason", reason)


@add(
    "running_lines",
    f"""SELECT doc_id, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS key, count(DISTINCT page) AS n_pages FROM {LINES}
    WHERE (y0 <= 0.12 * 842.0 OR y1 >= (1 - 0.12) * 842.0) AND length(regexp_replace(trim(text), '[0-9]+', '#', 'g')) >= 12 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3""",
)
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.running_lines(L.lines(_spans(spark, d)))


@add(
    "small_caps_lines",
    f"""SELECT doc_id, page, line_no FROM {duck("placed_spans")} WHERE regexp_matches(text, '[A-Za-z]') GROUP BY ALL
    HAVING count(DISTINCT round_even(size, 1)) >= 2 AND NOT bool_or(regexp_matches(text, '[a-z]'))""",
)
def small_caps_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.small_caps(_placed(spark, d))


_H = r"^(\d+(?:\.\d+)*|[A-Z](?:\.\d+)+)\.?\s+(\p{Lu}.*)$"
HEADINGS = f"""(SELECT l.doc_id, page, line_no, regexp_extract(text, '{_H}', 1) AS numbering, trim(regexp_extract(text, '{_H}', 2)) AS title,
CAST(len(string_split(regexp_extract(text, '{_H}', 1), '.')) AS INTEGER) AS depth FROM {LINES} l JOIN {BODY} b ON l.doc_id = b.doc_id
WHERE length(text) <= 90 AND length(text) >= 3 AND NOT regexp_matches(text, '[.,;:]\\s*$') AND (bold OR l.size >= b.size + 0.4) AND regexp_matches(text, '{_H}'))"""


@add("headings", f"SELECT * FROM {HEADINGS}")
def headings(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    return L.headings(L.lines(s), L.body_font_size(s))


@add(
    "heading_hierarchy",
    f"""WITH h AS (SELECT doc_id, page, line_no, numbering, depth, CASE WHEN depth > 1 THEN array_to_string(string_split(numbering, '.')[1:depth - 1], '.') ELSE '' END AS parent,
    TRY_CAST(string_split(numbering, '.')[depth] AS INTEGER) AS last FROM {HEADINGS}),
    w AS (SELECT *, lag(last) OVER (PARTITION BY doc_id, parent ORDER BY page, line_no) AS before FROM h)
    SELECT doc_id, page, line_no, numbering, CASE WHEN depth > 3 THEN 'too deep' WHEN depth > 1 AND NOT EXISTS (SELECT 1 FROM h p WHERE p.doc_id = w.doc_id AND p.numbering = w.parent AND (p.page, p.line_no) < (w.page, w.line_no)) THEN 'no parent'
    WHEN before IS NULL AND last <> 1 THEN 'does not start at 1' WHEN last - before > 1 THEN 'gap' END AS problem FROM w
    WHERE problem IS NOT NULL""",
)
def heading_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    from quire.operators.sequences import numbering_problems

    return numbering_problems(headings(spark, d))


@add("inside_graphic", f"SELECT * FROM {duck('placed_spans')} s WHERE EXISTS (SELECT 1 FROM {duck('boxes')} b WHERE b.doc_id = s.doc_id AND b.page = s.page AND s.x0 >= b.x0 - 2 AND s.y0 >= b.y0 - 2 AND s.x1 <= b.x1 + 2 AND s.y1 <= b.y1 + 2)")
def inside_graphic(spark: SparkSession, d: str) -> DataFrame:
    return L.inside_boxes(_placed(spark, d), projection(spark, d, "boxes"))


_OUT = f"NOT EXISTS (SELECT 1 FROM {duck('boxes')} b WHERE b.doc_id = s.doc_id AND b.page = s.page AND s.x0 >= b.x0 - 2 AND s.y0 >= b.y0 - 2 AND s.x1 <= b.x1 + 2 AND s.y1 <= b.y1 + 2)"
_KEY = "doc_id, page, line_no, span_no"


@add("min_font_size", f"SELECT {_KEY}, size FROM {duck('placed_spans')} s WHERE length(trim(text)) >= 3 AND size < 9 - 0.15 AND NOT render_mode IN (3, 7) AND NOT starts_with(font, 'CM') AND {_OUT}")
def min_font_size(spark: SparkSession, d: str) -> DataFrame:
    small = _placed(spark, d).filter((F.length(F.trim("text")) >= 3) & (F.col("size") < 9 - 0.15) & ~L.is_invisible(F.col("render_mode"), F.col("opacity")) & ~F.col("font").startswith("CM"))
    return L.inside_boxes(small, projection(spark, d, "boxes"), how="left_anti").select(*L.SPAN_KEY, "size")


@add("hidden_invisible_text", f"SELECT {_KEY}, text FROM {duck('placed_spans')} WHERE (render_mode IN (3, 7) OR opacity <= 0.01) AND regexp_matches(text, '[A-Za-z]')")
def hidden_invisible_text(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).filter(L.is_invisible(F.col("render_mode"), F.col("opacity")) & F.col("text").rlike("[A-Za-z]")).select(*L.SPAN_KEY, "text")


@add("hidden_tiny_text", f"SELECT {_KEY}, size FROM {duck('placed_spans')} s WHERE size <= 4 AND NOT render_mode IN (3, 7) AND regexp_matches(text, '[A-Za-z]') AND {_OUT}")
def hidden_tiny_text(spark: SparkSession, d: str) -> DataFrame:
    tiny = _placed(spark, d).filter((F.col("size") <= 4) & ~L.is_invisible(F.col("render_mode"), F.col("opacity")) & F.col("text").rlike("[A-Za-z]"))
    return L.inside_boxes(tiny, projection(spark, d, "boxes"), how="left_anti").select(*L.SPAN_KEY, "size")


@add(
    "hidden_low_contrast",
    f"""SELECT {_KEY}, round(0.2126 * ((color >> 16) & 255) / 255 + 0.7152 * ((color >> 8) & 255) / 255 + 0.0722 * (color & 255) / 255, 6) AS luminance
    FROM {duck("placed_spans")} s WHERE abs(0.2126 * ((color >> 16) & 255) / 255 + 0.7152 * ((color >> 8) & 255) / 255 + 0.0722 * (color & 255) / 255 - 1.0) <= 0.06 AND {_OUT}""",
)
def hidden_low_contrast(spark: SparkSession, d: str) -> DataFrame:
    pale = _placed(spark, d).filter(F.abs(L.luminance(F.col("color")) - 1.0) <= 0.06)
    return L.inside_boxes(pale, projection(spark, d, "boxes"), how="left_anti").select(*L.SPAN_KEY, F.round(L.luminance(F.col("color")), 6).alias("luminance"))


@add("hidden_offpage_text", f"SELECT {_KEY}, greatest(0 - x0, 0 - y0, x1 - 400, y1 - 700) AS over FROM {duck('placed_spans')} WHERE greatest(0 - x0, 0 - y0, x1 - 400, y1 - 700) > 3")
def hidden_offpage_text(spark: SparkSession, d: str) -> DataFrame:
    over = F.greatest(0 - F.col("x0"), 0 - F.col("y0"), F.col("x1") - 400, F.col("y1") - 700)
    return _placed(spark, d).withColumn("over", over).filter("over > 3").select(*L.SPAN_KEY, "over")


@add(
    "stacked_boxes",
    f"""SELECT doc_id, page, box_a, box_b, iou FROM (SELECT a.doc_id, a.page, a.box_no AS box_a, b.box_no AS box_b,
    (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS c, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s, round(c / (s - c), 6) AS iou
    FROM {duck("boxes")} a JOIN {duck("boxes")} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.box_no < b.box_no AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) WHERE iou > 0.5""",
)
def stacked_boxes(spark: SparkSession, d: str) -> DataFrame:
    return L.stacked_boxes(projection(spark, d, "boxes"))


@add(
    "margin_overshoots",
    f"""SELECT doc_id, page, line_no, side, round(over, 3) AS over FROM (SELECT doc_id, page, line_no, unnest(['left', 'right', 'top', 'bottom']) AS side,
    unnest([71.0 - x0, x1 - (595.0 - 71.0), 57.0 - y0, y1 - (842.0 - 62.0)]) AS over FROM {LINES}) WHERE round(over, 3) > 1""",
)
def margin_overshoots(spark: SparkSession, d: str) -> DataFrame:
    return L.margin_overshoots(L.lines(_spans(spark, d)))


@add(
    "pdf_health",
    """SELECT doc_id, coalesce(pdf_format, 'unknown') AS pdf_format, CASE WHEN size_bytes IS NULL THEN NULL ELSE round(size_bytes / 1e6, 3) END AS megabytes,
    concat_ws(',', CASE WHEN is_encrypted THEN 'encrypted' END, CASE WHEN is_repaired THEN 'repaired' END, CASE WHEN size_bytes > 10000000 THEN 'large' END, CASE WHEN page_count IS NULL THEN 'no page count' END) AS problems
    FROM (SELECT DISTINCT ON (doc_id) * FROM docs)""",
)
def pdf_health(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").dropDuplicates(["doc_id"])
    problems = F.concat_ws(
        ",",
        F.when(F.col("is_encrypted"), "encrypted"),
        F.when(F.col("is_repaired"), "repaired"),
        F.when(F.col("size_bytes") > 10_000_000, "large"),
        F.when(F.col("page_count").isNull(), "no page count"),
    )
    return docs.select("doc_id", F.coalesce("pdf_format", F.lit("unknown")).alias("pdf_format"), F.round(F.col("size_bytes") / 1e6, 3).alias("megabytes"), problems.alias("problems"))
