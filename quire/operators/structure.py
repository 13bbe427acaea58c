"""Document structure, spatial self-joins, references inside text, figures, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_render_modes(spans: DataFrame, modes: DataFrame) -> DataFrame:
    """Spans with the mode and opacity found at their rounded box (0 and 1 where none is)."""
    box = ["x0", "y0", "x1", "y1"]
    keyed = modes.select("doc_id", "page", *[F.bround(c).cast("int").alias(f"k_{c}") for c in box], "mode", "opacity").dropDuplicates(["doc_id", "page", *[f"k_{c}" for c in box]])
    s = spans.drop("opacity")
    for c in box:
        s = s.withColumn(f"k_{c}", F.bround(c).cast("int"))
    out = s.join(keyed, ["doc_id", "page", *[f"k_{c}" for c in box]], "left")
    return out.withColumn("mode", F.coalesce("mode", F.lit(0))).withColumn("opacity", F.coalesce("opacity", F.lit(1.0))).drop(*[f"k_{c}" for c in box])


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``first``, and ``second``'s rows for the keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def nearest_band(lines: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """``lines`` with ``band``: whose centre is nearest (ties: the first)."""
    centre = (F.col("x0") + F.col("x1")) / 2
    options = F.array(*[F.struct(F.abs(centre - (a + b) / 2).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(bands)])
    return lines.withColumn("band", F.array_min(options)["i"])


def left_neighbours(lines: DataFrame, dy: float = 1.5) -> DataFrame:
    """(doc_id, page, line_no, left_no): the line that ends nearest left of another on its baseline."""
    a = lines.select("doc_id", "page", "line_no", "x0", "y0", F.floor(F.col("y0") / 8).alias("r"))
    b = lines.select("doc_id", "page", F.col("line_no").alias("left_no"), F.col("x1").alias("lx1"), F.col("y0").alias("ly"), F.explode(F.sequence(F.floor((F.col("y0") - dy) / 8), F.floor((F.col("y0") + dy) / 8))).alias("r"))
    near = a.join(b, ["doc_id", "page", "r"]).filter((F.col("line_no") != F.col("left_no")) & (F.abs(F.col("y0") - F.col("ly")) <= dy) & (F.col("lx1") <= F.col("x0") + 1))
    best = F.row_number().over(Window.partitionBy("doc_id", "page", "line_no").orderBy(F.desc("lx1"), "left_no"))
    return near.withColumn("n", best).filter("n = 1").select("doc_id", "page", "line_no", "left_no")


def lines_below(lines: DataFrame, reach: float = 40.0, most: int = 4) -> DataFrame:
    """(doc_id, page, line_no, below_no, rank): up to ``most`` lines under a line that
    overlap it, within ``reach`` points (an equal join on bands of that height)."""
    a = lines.select("doc_id", "page", "line_no", "x0", "x1", "y1", F.explode(F.array(F.floor(F.col("y1") / reach), F.floor(F.col("y1") / reach) + 1)).alias("r"))
    b = lines.select("doc_id", "page", F.col("line_no").alias("below_no"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by"), F.floor(F.col("y0") / reach).alias("r"))
    hit = a.join(b, ["doc_id", "page", "r"]).filter((F.col("by") >= F.col("y1")) & (F.col("by") <= F.col("y1") + reach) & (F.col("bx0") < F.col("x1")) & (F.col("x0") < F.col("bx1")))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page", "line_no").orderBy("by", "below_no"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "page", "line_no", "below_no", "rank")


def extents(starts: DataFrame, keys: list[str], start: str) -> DataFrame:
    """``starts`` with ``end``: where the next one of the key begins (null: to the end)."""
    return starts.withColumn("end", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def expanded(numbers: Column) -> Column:
    """The numbers of "1-3, 5": ranges that run upwards by at most twenty, sorted, each once."""
    parts = F.split(F.regexp_replace(numbers, r"[–—]", "-"), r"\s*,\s*")

    def one(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*(\d+)$", 1), F.lit("")), F.regexp_extract(p, r"^(\d+)", 1)).try_cast("int")
        return F.when(lo.isNotNull() & (hi >= lo) & (hi - lo <= 20), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))


def year_letters(years: Column) -> Column:
    """ "2023a,b" as 2023a, 2023b: a bare letter takes the year before it."""
    start = F.struct(F.lit("").alias("y"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(\d{4})", 1)
        y = F.when(digits != "", digits).otherwise(acc["y"])
        whole = F.when(digits != "", p).otherwise(F.concat(acc["y"], p))
        return F.struct(y.alias("y"), F.concat(acc["out"], F.array(whole)).alias("out"))

    return F.aggregate(F.split(years, r"\s*,\s*"), start, step, lambda a: a["out"])


def around(text: Column, at: Column, length: Column, radius: int = 40) -> Column:
    """The text about a hit, cut at its sentence's ends."""
    left = F.greatest(at - radius, F.lit(1))
    before, after = text.substr(left, at - left), text.substr(at + length, F.lit(radius))
    return F.concat(F.regexp_replace(before, r"(?s)^.*\. ", ""), text.substr(at, length), F.regexp_replace(after, r"(?s)\. .*$", "."))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees; null for greys."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    c = hi - lo
    h = F.when(hi == r, ((g - b) / c) % 6).when(hi == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    return F.when(c > 0, F.pmod(h * 60, F.lit(360.0)))


# How a deuteranope sees red, green and blue.
DEUTERANOPIA = ((0.625, 0.375, 0.0), (0.7, 0.3, 0.0), (0.0, 0.3, 0.7))


def deuteranope(r: Column, g: Column, b: Column) -> list[Column]:
    return [m[0] * r + m[1] * g + m[2] * b for m in DEUTERANOPIA]


def colour_pairs(boxes: DataFrame) -> DataFrame:
    """(doc_id, box_a, box_b, before, after): of each document the first pair of colours
    that differ (0.25 or more) but not to a deuteranope (under 0.12)."""
    cols = boxes.select("doc_id", "r", "g", "b", "box_no").groupBy("doc_id", "r", "g", "b").agg(F.min("box_no").alias("box_no"))
    a = cols.select("doc_id", *[F.col(c).alias(f"a_{c}") for c in ("r", "g", "b")], F.col("box_no").alias("box_a"))
    b = cols.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("r", "g", "b")], F.col("box_no").alias("box_b"))
    p = a.join(b, "doc_id").filter("box_a < box_b")
    dist = lambda x, y: F.sqrt(sum((u - v) * (u - v) for u, v in zip(x, y, strict=True)))
    ca, cb = [F.col(f"a_{c}") for c in "rgb"], [F.col(f"b_{c}") for c in "rgb"]
    d = p.withColumn("before", F.round(dist(ca, cb), 6)).withColumn("after", F.round(dist(deuteranope(*ca), deuteranope(*cb)), 6)).filter("before >= 0.25 AND after < 0.12")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("box_a", "box_b"))
    return d.withColumn("n", n).filter("n = 1").select("doc_id", "box_a", "box_b", "before", "after")


def issues(replies: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, check_id, rank, severity, text): the issues of model replies (JSON, maybe in
    a fence or with words around), high before medium before low, ``most`` a reply; a
    reply that is no JSON has one row of rank 0 and severity skipped."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "struct<issues:array<struct<severity:string,text:string>>>")
    r = replies.select("doc_id", "check_id", parsed.alias("p"))
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ("high", "medium", "low")]), F.col("i.severity")), F.lit(9))
    x = r.filter("p IS NOT NULL").select("doc_id", "check_id", F.posexplode("p.issues").alias("pos", "i"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "check_id").orderBy(order, "pos"))
    out = x.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "check_id", "rank", F.col("i.severity").alias("severity"), F.col("i.text").alias("text"))
    return out.unionByName(r.filter("p IS NULL").select("doc_id", "check_id", F.lit(0).alias("rank"), F.lit("skipped").alias("severity"), F.lit(None).cast("string").alias("text")))


def segmented(lines: DataFrame) -> DataFrame:
    """(doc_id, entry, text): bibliography lines (doc_id, pos, text) joined to entries,
    each of which starts with a label; a word broken at a line's end is joined."""
    starts = F.col("text").rlike(r"^\s*\[\d+\]")
    w = Window.partitionBy("doc_id").orderBy("pos")
    e = lines.withColumn("entry", F.sum(F.when(starts, 1).otherwise(0)).over(w)).filter("entry > 0")
    parts = e.groupBy("doc_id", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("ls"))
    joined = F.aggregate("ls", F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.rlike(r"\w-$"), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x)))
    return parts.select("doc_id", "entry", joined.alias("text"))
