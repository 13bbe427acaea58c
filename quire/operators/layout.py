"""Page geometry: lines, columns, reading order, fonts, boxes.

Input contract: ``spans`` (doc_id, page, line_no, span_no, x0, y0, x1, y1, text,
font, size, color, flags, render_mode, opacity).  Every join and window is keyed
by document and page, so work spreads over pages; only counts go to the document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_KEY = ["doc_id", "page", "line_no", "span_no"]


def delivered_once(spans: DataFrame) -> DataFrame:
    """One row a span, whatever was delivered twice."""
    return spans.dropDuplicates(SPAN_KEY)


def is_bold(font: Column, flags: Column) -> Column:
    return (F.coalesce(flags, F.lit(0)).bitwiseAND(16) != 0) | F.coalesce(F.lower(font).contains("bold"), F.lit(False))


def is_invisible(mode: Column, opacity: Column) -> Column:
    """Drawn with no ink: render modes 3 and 7, or next to no opacity."""
    return mode.isin(3, 7) | (F.coalesce(opacity, F.lit(1.0)) <= 0.01)


def luminance(color: Column) -> Column:
    """Relative luminance of a packed RGB colour."""
    r, g, b = (F.shiftright(color, s).bitwiseAND(255) / 255 for s in (16, 8, 0))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, x0, y0, x1, y1, size, bold): the size is the widest
    span's (the first of several), bold where over 60 % of the visible width is."""
    width = F.col("x1") - F.col("x0")
    seen = ~is_invisible(F.col("render_mode"), F.col("opacity"))
    parts = spans.select(*SPAN_KEY, "text", "x0", "y0", "x1", "y1", "size", width.alias("w"), F.when(seen, width).otherwise(0.0).alias("v"), F.when(seen & is_bold(F.col("font"), F.col("flags")), width).otherwise(0.0).alias("b"))
    out = parts.groupBy("doc_id", "page", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("span_no", "text"))).alias("s"),
        *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1")],
        F.max_by("size", F.struct("w", -F.col("span_no"))).alias("size"),
        (F.sum("b") > 0.6 * F.sum("v")).alias("bold"),
    )
    return out.select("doc_id", "page", "line_no", F.array_join("s.text", "").alias("text"), "x0", "y0", "x1", "y1", "size", "bold")


def body_lines(line: DataFrame, height: float = 842.0, band: float = 0.08) -> DataFrame:
    """Lines with a letter, away from the outer bands of the page."""
    return line.filter(F.col("text").rlike("[A-Za-z]") & (F.col("y0") >= band * height) & (F.col("y1") <= (1 - band) * height))


def left_edges(line: DataFrame) -> DataFrame:
    """(doc_id, edge, n): histogram of left edges in steps of two points."""
    return line.groupBy("doc_id", F.bround(F.col("x0") / 2).cast("int").alias("edge")).agg(F.count("*").alias("n"))


def column_bands(line: DataFrame, apart: float = 40.0, most: int = 4, least: int = 3, width: float = 595.0) -> DataFrame:
    """(doc_id, band, x0, x1): the text columns of each document.

    Peaks of the left-edge histogram are taken by height while ``apart`` points
    from those taken; a second band needs a sixth of the first one's lines a quarter of
    the page away.  A band is as wide as nine tenths of its lines.  The picking is
    sequential, over at most a page width of histogram steps a document."""
    edges = left_edges(line).filter(F.col("n") >= least)
    steps = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("edge", "n"))).alias("h"))

    def pick(parts):
        for pdf in parts:
            rows = []
            for doc, h in zip(pdf["doc_id"], pdf["h"], strict=True):
                taken: list[tuple[float, int]] = []
                for edge, n in sorted(((x["edge"] * 2.0, x["n"]) for x in h), key=lambda p: (-p[1], p[0])):
                    if len(taken) < most and all(abs(edge - t) >= apart for t, _ in taken):
                        taken.append((edge, n))
                if taken:
                    keep = [taken[0]]
                    second = next((t for t in taken[1:] if abs(t[0] - taken[0][0]) > 0.25 * width and t[1] >= 0.15 * taken[0][1]), None)
                    keep += [second] if second else []
                    rows += [(doc, i, e) for i, (e, _) in enumerate(sorted(keep))]
            yield pd.DataFrame(rows, columns=["doc_id", "band", "left"])

    peaks = steps.mapInPandas(pick, "doc_id long, band int, left double")
    limit = F.lead("left").over(Window.partitionBy("doc_id").orderBy("band"))
    bounded = peaks.withColumn("limit", F.coalesce(limit, F.lit(1e9)))
    at = line.join(bounded, "doc_id").filter((F.abs(F.col("x0") - F.col("left")) <= 4) & (F.col("x1") <= F.col("limit") - 1))
    widths = at.groupBy("doc_id", "band", "left").agg(F.sort_array(F.collect_list(F.col("x1") - F.col("x0"))).alias("w"))
    ninth = F.element_at("w", F.least(F.floor(F.size("w") * 0.9) + 1, F.size("w")).cast("int"))
    return widths.select("doc_id", "band", F.col("left").alias("x0"), (F.col("left") + ninth).alias("x1"))


def reading_order(line: DataFrame, middle: float = 300.0) -> DataFrame:
    """``line`` with ``pos``: the order by page, column, height and left edge."""
    column = F.when(F.col("x0") >= middle, 1).otherwise(0)
    order = Window.partitionBy("doc_id", "page").orderBy(column, F.bround("y0", 1), "x0", "line_no")
    return line.withColumn("pos", F.row_number().over(order))


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, order: Column) -> DataFrame:
    """(keys, value, share): the value with the most weight, ties to the first seen."""
    sums = df.groupBy(*keys, value.alias("value")).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    whole = Window.partitionBy(*keys)
    ranked = sums.withColumn("share", F.col("w") / F.sum("w").over(whole)).withColumn("n", F.row_number().over(whole.orderBy(F.desc("w"), "first")))
    return ranked.filter("n = 1").select(*keys, "value", F.round("share", 6).alias("share"))


def seen_order() -> Column:
    return F.struct("page", "line_no", "span_no")


def body_font_size(spans: DataFrame) -> DataFrame:
    """(doc_id, size): the size most letters are set in, to half a point."""
    long = spans.filter(F.length(F.trim("text")) >= 2)
    out = weighted_mode(long, ["doc_id"], F.bround(F.col("size") * 2) / 2, F.length(F.trim("text")), seen_order())
    return out.select("doc_id", F.col("value").alias("size"))


def dominant_font(spans: DataFrame) -> DataFrame:
    """(doc_id, font, share) of the font most letters are set in."""
    named = spans.filter(F.col("font").isNotNull() & (F.length(F.trim("text")) >= 1))
    return weighted_mode(named, ["doc_id"], F.col("font"), F.length(F.trim("text")), seen_order()).withColumnRenamed("value", "font")


def running_lines(line: DataFrame, height: float = 842.0, band: float = 0.12, pages: int = 3) -> DataFrame:
    """(doc_id, key, n_pages): texts that return at the pages' edges, digits as #."""
    key = F.regexp_replace(F.trim("text"), "[0-9]+", "#")
    edge = (F.col("y0") <= band * height) | (F.col("y1") >= (1 - band) * height)
    near = line.filter(edge).withColumn("key", key).filter(F.length("key") >= 12)
    return near.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("n_pages")).filter(F.col("n_pages") >= pages)


def small_caps(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_no): all letters upper, in two sizes or more."""
    lettered = spans.filter(F.col("text").rlike("[A-Za-z]"))
    g = lettered.groupBy("doc_id", "page", "line_no").agg(F.countDistinct(F.bround("size", 1)).alias("n"), F.max(F.col("text").rlike("[a-z]")).alias("low"))
    return g.filter("n >= 2 AND NOT low").select("doc_id", "page", "line_no")


def headings(line: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, numbering, title, depth): short, capitalised, without an
    end mark, and bold or larger than the body text."""
    rx = r"^(\d+(?:\.\d+)*|[A-Z](?:\.\d+)+)\.?\s+(\p{Lu}.*)$"
    short = (F.length("text") <= 90) & (F.length("text") >= 3) & ~F.col("text").rlike(r"[.,;:]\s*$")
    named = line.join(body.withColumnRenamed("size", "body"), "doc_id").filter(short & (F.col("bold") | (F.col("size") >= F.col("body") + 0.4)) & F.col("text").rlike(rx))
    number = F.regexp_extract("text", rx, 1)
    return named.select("doc_id", "page", "line_no", number.alias("numbering"), F.trim(F.regexp_extract("text", rx, 2)).alias("title"), F.size(F.split(number, r"\.")).alias("depth"))


def grid_cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """The cells of a page grid that a box touches."""
    xs = F.sequence(F.floor(x0 / cell), F.floor(x1 / cell))
    ys = F.sequence(F.floor(y0 / cell), F.floor(y1 / cell))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def inside_boxes(spans: DataFrame, boxes: DataFrame, slack: float = 2.0, cell: float = 128.0, how: str = "left_semi") -> DataFrame:
    """Spans inside (left_semi) or outside (left_anti) every box of their page.

    A span inside a box lies in the box's cell at the span's corner, so an equal
    join on page and cell meets all pairs and no page is one task's work."""
    at = boxes.select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(grid_cells(F.greatest(F.col("x0") - slack, F.lit(0)), F.greatest(F.col("y0") - slack, F.lit(0)), F.col("x1"), F.col("y1"), cell)).alias("c")).select("*", "c.i", "c.j").drop("c")
    own = spans.withColumn("i", F.floor(F.greatest("x0", F.lit(0)) / cell)).withColumn("j", F.floor(F.greatest("y0", F.lit(0)) / cell))
    s = own.alias("s")
    b = at.alias("b")
    inside = (
        (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.page") == F.col("b.page")) & (F.col("s.i") == F.col("b.i")) & (F.col("s.j") == F.col("b.j"))
        & (F.col("s.x0") >= F.col("b_x0") - slack) & (F.col("s.y0") >= F.col("b_y0") - slack) & (F.col("s.x1") <= F.col("b_x1") + slack) & (F.col("s.y1") <= F.col("b_y1") + slack)
    )
    return s.join(b, inside, how).select(*[f"s.{c}" for c in spans.columns])


def stacked_boxes(boxes: DataFrame, share: float = 0.5, cell: float = 128.0) -> DataFrame:
    """(doc_id, page, box_a, box_b, iou): pairs of boxes of a page that overlap by more than ``share`` of their union.

    Boxes meet by cells of a page grid, a pair at the cell of its common part's corner alone."""

    def side(no: str, p: str) -> DataFrame:
        own = boxes.select("doc_id", "page", F.col("box_no").alias(no), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(grid_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)).alias("c"))
        return own.select("*", "c.i", "c.j").drop("c")

    here = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("i")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("j"))
    both = side("box_a", "a").join(side("box_b", "b"), ["doc_id", "page", "i", "j"]).filter("box_a < box_b AND a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1").filter(here)
    common = (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) * (F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    return both.withColumn("iou", F.round(common / (area("a") + area("b") - common), 6)).filter(F.col("iou") > share).select("doc_id", "page", "box_a", "box_b", "iou")


def column_fit(line: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, page, fit): share of a page's letters inside some column, 0 with fewer than two columns."""
    lists = bands.groupBy("doc_id").agg(F.collect_list(F.struct("x0", "x1")).alias("bands"))
    at = line.join(lists, "doc_id", "left")
    fits = F.exists("bands", lambda b: (F.col("x0") >= b["x0"] - 3) & (F.col("x1") <= b["x1"] + 6))
    n = F.length("text")
    ok = F.when(fits & (F.size("bands") >= 2), n).otherwise(0)
    return at.groupBy("doc_id", "page").agg(F.round(F.sum(ok) / F.greatest(F.sum(n), F.lit(1)), 6).alias("fit"))


def margin_overshoots(line: DataFrame, left: float = 71.0, right: float = 71.0, top: float = 57.0, bottom: float = 62.0, width: float = 595.0, height: float = 842.0, least: float = 1.0) -> DataFrame:
    """(doc_id, page, line_no, side, over): how far lines stand beyond the margins."""
    sides = F.array(
        F.struct(F.lit("left").alias("side"), (F.lit(left) - F.col("x0")).alias("over")),
        F.struct(F.lit("right").alias("side"), (F.col("x1") - (width - right)).alias("over")),
        F.struct(F.lit("top").alias("side"), (F.lit(top) - F.col("y0")).alias("over")),
        F.struct(F.lit("bottom").alias("side"), (F.col("y1") - (height - bottom)).alias("over")),
    )
    out = line.select("doc_id", "page", "line_no", F.explode(sides).alias("s")).select("doc_id", "page", "line_no", "s.side", F.round("s.over", 3).alias("over"))
    return out.filter(F.col("over") > least)
