"""More of the check catalogue over the test tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import layout as L
from quire.operators import structure as T
from quire.operators.layout_queries import HEADINGS, LINES, SPANS
from quire.plans.plan_queries import FOUND, _reported
from quire.querybook import book
from quire.sources.projections import duck, projection
from quire.sources.tables import table

QUERIES, ORACLE, add = book()


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return L.delivered_once(table(spark, d, "spans"))


@add("blank_pages", f"SELECT DISTINCT doc_id, page FROM {SPANS} s WHERE NOT EXISTS (SELECT 1 FROM {SPANS} t WHERE t.doc_id = s.doc_id AND t.page = s.page AND regexp_matches(t.text, '[A-Za-z]{{20,}}|[A-Za-z]+ [a-z]+ [a-z]+'))")
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    full = s.filter(F.col("text").rlike("[A-Za-z]{20,}|[A-Za-z]+ [a-z]+ [a-z]+")).select("doc_id", "page").distinct()
    return s.select("doc_id", "page").distinct().join(full, ["doc_id", "page"], "left_anti")


@add("total_page_limit", "SELECT doc_id, page_count FROM (SELECT DISTINCT doc_id, page_count FROM docs) WHERE page_count > 3")
def total_page_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", "page_count").distinct().filter("page_count > 3")


@add(
    "title_text",
    f"""WITH p AS (SELECT * FROM {LINES} WHERE page = 1), m AS (SELECT doc_id, max(size) AS top FROM p GROUP BY 1), r AS (SELECT p.doc_id, p.text, row_number() OVER (PARTITION BY p.doc_id ORDER BY y0, x0, line_no) AS n, p.size >= m.top - 0.5 AS big FROM p JOIN m ON p.doc_id = m.doc_id),
    f AS (SELECT doc_id, min(n) AS first FROM r WHERE big GROUP BY 1), b AS (SELECT r.doc_id, min(r.n) AS stop FROM r JOIN f ON r.doc_id = f.doc_id WHERE NOT big AND r.n > f.first GROUP BY 1)
    SELECT r.doc_id, string_agg(r.text, ' ' ORDER BY r.n) AS title FROM r JOIN f ON r.doc_id = f.doc_id LEFT JOIN b ON r.doc_id = b.doc_id WHERE r.n >= f.first AND (b.stop IS NULL OR r.n < b.stop) GROUP BY 1""",
)
def title_text(spark: SparkSession, d: str) -> DataFrame:
    """The largest lines of the first page, as far as they follow one another."""
    p = L.lines(_spans(spark, d)).filter("page = 1")
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("y0", "x0", "line_no")
    r = p.withColumn("n", F.row_number().over(order)).withColumn("big", F.col("size") >= F.max("size").over(doc) - 0.5)
    r = r.withColumn("first", F.min(F.when(F.col("big"), F.col("n"))).over(doc)).withColumn("stop", F.min(F.when(~F.col("big") & (F.col("n") > F.col("first")), F.col("n"))).over(doc))
    kept = r.filter((F.col("n") >= F.col("first")) & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("title"))


@add(
    "empty_headings",
    f"""WITH h AS (SELECT doc_id, CAST(page AS BIGINT) * 10000 + line_no AS pos, numbering FROM {HEADINGS}), l AS (SELECT doc_id, CAST(page AS BIGINT) * 10000 + line_no AS pos, text FROM {LINES}),
    s AS (SELECT l.doc_id, l.text, (SELECT max(h.pos) FROM h WHERE h.doc_id = l.doc_id AND h.pos < l.pos) AS at FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND h.pos = l.pos))
    SELECT h.doc_id, h.pos, h.numbering FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND s.at = h.pos GROUP BY 1, 2, 3 HAVING coalesce(sum(len(list_filter(string_split(s.text, ' '), lambda w: w <> ''))), 0) < 3""",
)
def empty_headings(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    line = L.lines(s)
    h = L.headings(line, L.body_font_size(s)).select("doc_id", "page", "line_no", "numbering")
    pos = (F.col("page").cast("bigint") * 10000 + F.col("line_no")).alias("pos")
    both = line.join(h, ["doc_id", "page", "line_no"], "left").select("doc_id", pos, "text", "numbering")
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.col("numbering").isNotNull()
    at = both.withColumn("at", F.last(F.when(head, F.col("pos")), True).over(w))
    words = F.when(~head, F.size(F.filter(F.split("text", " "), lambda x: x != ""))).otherwise(0)
    g = at.filter("at IS NOT NULL").groupBy("doc_id", F.col("at").alias("pos")).agg(F.sum(words).alias("n"), F.max("numbering").alias("numbering"))
    return g.filter("n < 3").select("doc_id", "pos", "numbering")


@add("font_embedding", f"SELECT font, min(page) AS page, count(*) AS n FROM {duck('placed_spans')} WHERE NOT regexp_matches(font, '^[A-Z]{{6}}\\+') AND NOT regexp_matches(font, '^(Helvetica|Times|Courier|Symbol|ZapfDingbats)') GROUP BY 1")
def font_embedding(spark: SparkSession, d: str) -> DataFrame:
    f = projection(spark, d, "placed_spans").filter(~F.col("font").rlike(r"^[A-Z]{6}\+") & ~F.col("font").rlike("^(Helvetica|Times|Courier|Symbol|ZapfDingbats)"))
    return f.groupBy("font").agg(F.min("page").alias("page"), F.count("*").alias("n"))


@add("panel_completeness", "WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(97 + l_partkey % 6 AS INTEGER) AS c FROM lineitem), m AS (SELECT doc_id, max(c) AS top, count(*) AS n FROM p GROUP BY 1) SELECT m.doc_id, chr(CAST(g.c AS INTEGER)) AS panel FROM m, LATERAL (SELECT unnest(generate_series(97, m.top)) AS c) g WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p.c = g.c)")
def panel_completeness(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (97 + F.col("l_partkey") % 6).cast("int").alias("c"))
    g = p.groupBy("doc_id").agg(F.collect_set("c").alias("cs")).filter(F.size("cs") >= 2)
    missing = F.array_except(F.sequence(F.lit(97), F.array_max("cs")), F.col("cs"))
    return g.select("doc_id", F.explode(missing).alias("c")).select("doc_id", F.char("c").alias("panel"))


_LUM = "0.2126 * {p}.r + 0.7152 * {p}.g + 0.0722 * {p}.b"


_HUE = """CASE WHEN greatest({p}.r, {p}.g, {p}.b) = least({p}.r, {p}.g, {p}.b) THEN NULL
WHEN greatest({p}.r, {p}.g, {p}.b) = {p}.r THEN 60 * (({p}.g - {p}.b) / (greatest({p}.r, {p}.g, {p}.b) - least({p}.r, {p}.g, {p}.b)))
WHEN greatest({p}.r, {p}.g, {p}.b) = {p}.g THEN 60 * (2 + ({p}.b - {p}.r) / (greatest({p}.r, {p}.g, {p}.b) - least({p}.r, {p}.g, {p}.b)))
ELSE 60 * (4 + ({p}.r - {p}.g) / (greatest({p}.r, {p}.g, {p}.b) - least({p}.r, {p}.g, {p}.b))) END"""
# Degrees that hues of a figure are apart, luminance by which they then must differ.
APART, LUMINANCE = 60, 0.10
_AROUND = "abs(x.hue - y.hue)"


@add(
    "figure_grayscale",
    f"""WITH c AS (SELECT DISTINCT doc_id, r, g, b, {_HUE.format(p='q')} AS hue, round({_LUM.format(p='q')}, 9) AS lum FROM {duck('boxes')} q)
    SELECT x.doc_id, count(*) AS n FROM c x JOIN c y ON x.doc_id = y.doc_id AND (x.r, x.g, x.b) < (y.r, y.g, y.b) AND round(least({_AROUND}, 360 - {_AROUND}), 9) >= {APART} AND round(abs(x.lum - y.lum), 9) < {LUMINANCE} GROUP BY 1""",
)
def figure_grayscale(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a document's distinct colours that differ in hue and fall together in grey."""
    c = projection(spark, d, "boxes").select("doc_id", "r", "g", "b").distinct()
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hue = F.when(hi == lo, F.lit(None)).when(hi == r, 60 * ((g - b) / (hi - lo))).when(hi == g, 60 * (2 + (b - r) / (hi - lo))).otherwise(60 * (4 + (r - g) / (hi - lo)))
    c = c.select("doc_id", F.struct("r", "g", "b").alias("rgb"), hue.alias("hue"), F.round(0.2126 * r + 0.7152 * g + 0.0722 * b, 9).alias("lum"))
    y = c.select("doc_id", *[F.col(k).alias(f"y_{k}") for k in ("rgb", "hue", "lum")])
    around = F.abs(F.col("hue") - F.col("y_hue"))
    hit = c.join(y, "doc_id").filter((F.col("rgb") < F.col("y_rgb")) & (F.round(F.least(around, 360 - around), 9) >= APART) & (F.round(F.abs(F.col("lum") - F.col("y_lum")), 9) < LUMINANCE))
    return hit.groupBy("doc_id").agg(F.count("*").alias("n"))


@add("abstract_length", r"SELECT doc_id, n, CASE WHEN n < 80 THEN 'short' WHEN n > 300 THEN 'long' END AS problem FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM documents WHERE section = 'intro' AND text IS NOT NULL) WHERE n < 80 OR n > 300")
def abstract_length(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("section = 'intro' AND text IS NOT NULL")
    n = t.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("n"))
    return n.filter("n < 80 OR n > 300").withColumn("problem", F.when(F.col("n") < 80, "short").otherwise("long"))


@add("unverifiable", "SELECT d.doc_id, u.item FROM (SELECT DISTINCT doc_id FROM docs) d CROSS JOIN (SELECT unnest(['dual submission', 'consent of authors', 'novelty']) AS item) u")
def unverifiable(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(*[F.lit(x) for x in ("dual submission", "consent of authors", "novelty")])
    return table(spark, d, "docs").select("doc_id").distinct().select("doc_id", F.explode(items).alias("item"))


_CODES = ["A1", "A2", "B1", "B2", "B3", "B4", "B5", "B6", "C1", "C2", "C3", "C4", "D1", "D2", "D3", "D4", "D5", "E1"]
_ITEM = r"[A-Z][0-9]+\. [^\n]*\n\[(?:Yes|No|N/A|TODO)\][^\n]*"


@add(
    "checklist_missing",
    rf"""WITH a AS (SELECT DISTINCT doc_id, regexp_extract(h, '^([A-Z][0-9]+)', 1) AS code FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ITEM}')) AS h FROM documents WHERE source = 'checklist')), e AS (SELECT unnest([{", ".join(f"'{c}'" for c in _CODES)}]) AS code)
    SELECT d.doc_id, e.code FROM (SELECT DISTINCT doc_id FROM a) d CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = d.doc_id AND a.code = e.code)""",
)
def checklist_missing(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").filter("source = 'checklist'").select("doc_id", F.regexp_extract_all("text", F.lit(rf"({_ITEM})"), 1).alias("hs"))
    codes = F.transform("hs", lambda x: F.regexp_extract(x, "^([A-Z][0-9]+)", 1))
    missing = F.array_except(F.array(*[F.lit(c) for c in _CODES]), codes)
    return h.filter(F.size("hs") > 0).select("doc_id", F.explode(missing).alias("code"))


@add("checklist_justifications", rf"SELECT doc_id, regexp_extract(h, '^([A-Z][0-9]+)', 1) AS code, length(trim(regexp_extract(h, '\]([^\n]*)$', 1))) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ITEM}')) AS h FROM documents WHERE source = 'checklist') WHERE regexp_matches(h, '\[(No|N/A)\]') AND length(trim(regexp_extract(h, '\]([^\n]*)$', 1))) < 15")
def checklist_justifications(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").filter("source = 'checklist'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"({_ITEM})"), 1)).alias("h"))
    n = F.length(F.trim(F.regexp_extract("h", r"\]([^\n]*)$", 1)))
    return h.filter(F.col("h").rlike(r"\[(No|N/A)\]")).select("doc_id", F.regexp_extract("h", "^([A-Z][0-9]+)", 1).alias("code"), n.cast("bigint").alias("n")).filter("n < 15")


@add("section_extents", f"""SELECT doc_id, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS "end" FROM (SELECT DISTINCT doc_id, CAST(page AS BIGINT) * 10000 + line_no AS start FROM {HEADINGS})""")
def section_extents(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    h = L.headings(L.lines(s), L.body_font_size(s)).select("doc_id", (F.col("page").cast("bigint") * 10000 + F.col("line_no")).alias("start")).distinct()
    return T.extents(h, ["doc_id"], "start")


@add("reference_details", "SELECT field, count(*) AS n, count(DISTINCT verdict_id) AS verdicts FROM (SELECT verdict_id, discrepancies->>('$[' || k || '].field') AS field FROM (SELECT DISTINCT verdict_id, CAST(discrepancies AS JSON) AS discrepancies FROM verdicts WHERE json_valid(discrepancies) AND starts_with(discrepancies, '[')), generate_series(0, 9) g(k)) WHERE field IS NOT NULL GROUP BY 1")
def reference_details(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verdicts").select("verdict_id", "discrepancies").distinct().filter(F.try_parse_json("discrepancies").isNotNull() & F.col("discrepancies").startswith("["))
    f = v.select("verdict_id", F.explode(F.from_json("discrepancies", "array<struct<field:string>>")).alias("x")).select("verdict_id", "x.field").filter("field IS NOT NULL")
    return f.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("verdict_id").alias("verdicts"))


@add("person_names", r"SELECT DISTINCT name, regexp_matches(name, '^(\p{Lu}[\p{L}.-]*\s+){1,3}\p{Lu}[\p{L}.-]*$') AND len(string_split_regex(name, '\s+')) <= 5 AS person FROM (SELECT unnest(authors) AS name FROM bib_entries) WHERE name IS NOT NULL")
def person_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "bib_entries").select(F.explode("authors").alias("name")).filter("name IS NOT NULL").distinct()
    return n.withColumn("person", F.col("name").rlike(r"^(\p{Lu}[\p{L}.-]*\s+){1,3}\p{Lu}[\p{L}.-]*$") & (F.size(F.split("name", r"\s+")) <= 5))


@add("cache_keys", r"SELECT entry_id, 'v12:' || left(sha1(regexp_replace(lower(raw), '\s+', '', 'g')), 24) AS key FROM (SELECT DISTINCT entry_id, raw FROM bib_entries WHERE raw IS NOT NULL)")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_entries").filter("raw IS NOT NULL").select("entry_id", "raw").distinct().select("entry_id", C.cache_key(F.col("raw")).alias("key"))


_Q = r"trim(regexp_replace(detail, '\s+', ' ', 'g'))"


@add("shortened_quotes", f"SELECT verdict_id, CASE WHEN length({_Q}) > 40 THEN left({_Q}, 39) || '…' ELSE {_Q} END AS quote FROM (SELECT DISTINCT verdict_id, note AS detail FROM verdicts WHERE note IS NOT NULL)")
def shortened_quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verdicts").filter("note IS NOT NULL").select("verdict_id", "note").distinct().select("verdict_id", C.shortened(F.col("note"), 40).alias("quote"))


@add("numbered_findings", f"SELECT doc_id, check_id, page, severity, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['error', 'warning', 'pass', 'skipped'], severity), check_id, page) AS number FROM {FOUND}")
def numbered_findings(spark: SparkSession, d: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in ("error", "warning", "pass", "skipped")]), F.col("severity"))
    w = Window.partitionBy("doc_id").orderBy(rank, "check_id", "page")
    return _reported(spark, d).select("doc_id", "check_id", "page", "severity", F.row_number().over(w).cast("bigint").alias("number"))


@add("capped_evidence", f"SELECT doc_id, severity, array_to_string(list_sort(list(DISTINCT page))[1:3], ',') AS pages, count(*) AS n FROM {FOUND} GROUP BY 1, 2")
def capped_evidence(spark: SparkSession, d: str) -> DataFrame:
    g = _reported(spark, d).groupBy("doc_id", "severity").agg(F.array_sort(F.collect_set("page")).alias("ps"), F.count("*").alias("n"))
    return g.select("doc_id", "severity", F.array_join(F.slice("ps", 1, 3), ",").alias("pages"), "n")


@add("running_heads", f"SELECT doc_id, page, line_no FROM {LINES} WHERE y0 <= 0.06 * 842.0 AND regexp_matches(text, '(Journal|Workshop|Conference) ')")
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(_spans(spark, d)).filter((F.col("y0") <= 0.06 * 842.0) & F.col("text").rlike("(Journal|Workshop|Conference) ")).select("doc_id", "page", "line_no")


@add("late_arrivals", "SELECT source, count(*) AS n, count(*) FILTER (ingested_at > fetched_at + INTERVAL 1 DAY) AS late, max(epoch_us(ingested_at) - epoch_us(fetched_at)) // 1000000 AS worst FROM records WHERE ingested_at IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1")
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").filter("ingested_at IS NOT NULL AND fetched_at IS NOT NULL")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lag = micros("ingested_at") - micros("fetched_at")
    return r.groupBy("source").agg(F.count("*").alias("n"), F.count_if(lag > 86_400_000_000).alias("late"), F.floor(F.max(lag) / 1_000_000).cast("bigint").alias("worst"))
