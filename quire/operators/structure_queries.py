"""Queries of the structure operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import structure as T
from quire.querybook import book
from quire.sources.projections import duck, projection
from quire.sources.tables import table

QUERIES, ORACLE, add = book()


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "placed_spans")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_lines").dropDuplicates(["doc_id", "page", "line_no"])


PL = "(SELECT DISTINCT ON (doc_id, page, line_no) * FROM page_lines)"
_MODES = "SELECT doc_id, page, x0 + 0.2 AS x0, y0 - 0.2 AS y0, x1, y1, 3 AS mode, 0.5 AS opacity FROM {t} WHERE span_no % 5 = 0"
_RB = ", ".join(f"CAST(round_even({c}, 0) AS INTEGER) AS k_{c}" for c in ("x0", "y0", "x1", "y1"))


@add(
    "render_mode_lookup",
    f"""SELECT s.doc_id, s.page, s.line_no, s.span_no, coalesce(m.mode, 0) AS mode, coalesce(m.opacity, 1.0) AS opacity FROM (SELECT *, {_RB} FROM {duck("placed_spans")}) s
    LEFT JOIN (SELECT DISTINCT doc_id, page, {_RB}, mode, CAST(opacity AS DOUBLE) AS opacity FROM ({_MODES.format(t=duck("placed_spans"))})) m ON s.doc_id = m.doc_id AND s.page = m.page AND s.k_x0 = m.k_x0 AND s.k_y0 = m.k_y0 AND s.k_x1 = m.k_x1 AND s.k_y1 = m.k_y1""",
)
def render_mode_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = _placed(spark, d)
    modes = s.filter("span_no % 5 = 0").select("doc_id", "page", (F.col("x0") + 0.2).alias("x0"), (F.col("y0") - 0.2).alias("y0"), "x1", "y1", F.lit(3).alias("mode"), F.lit(0.5).alias("opacity"))
    return T.with_render_modes(s, modes).select("doc_id", "page", "line_no", "span_no", "mode", "opacity")


@add("glyph_run_fallback", f"SELECT doc_id, page, count(*) AS n FROM (SELECT doc_id, page FROM spans WHERE render_mode = 0 UNION ALL SELECT doc_id, page FROM page_lines p WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.render_mode = 0 AND s.doc_id = p.doc_id AND s.page = p.page)) GROUP BY 1, 2")
def glyph_run_fallback(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "spans").filter("render_mode = 0").select("doc_id", "page")
    return T.with_fallback(a, table(spark, d, "page_lines").select("doc_id", "page"), ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


_BANDS = [(71.0, 290.0), (306.0, 525.0)]


@add("line_to_column", f"SELECT doc_id, page, line_no, CASE WHEN abs((x0 + x1) / 2 - {(71.0 + 290.0) / 2}) <= abs((x0 + x1) / 2 - {(306.0 + 525.0) / 2}) THEN 0 ELSE 1 END AS band FROM {PL}")
def line_to_column(spark: SparkSession, d: str) -> DataFrame:
    return T.nearest_band(_lines(spark, d), _BANDS).select("doc_id", "page", "line_no", "band")


@add(
    "left_neighbours",
    f"""SELECT doc_id, page, line_no, left_no FROM (SELECT a.doc_id, a.page, a.line_no, b.line_no AS left_no, row_number() OVER (PARTITION BY a.doc_id, a.page, a.line_no ORDER BY b.x1 DESC, b.line_no) AS n
    FROM {PL} a JOIN {PL} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no <> b.line_no AND abs(a.y0 - b.y0) <= 1.5 AND b.x1 <= a.x0 + 1) WHERE n = 1""",
)
def left_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return T.left_neighbours(_lines(spark, d))


@add(
    "lines_below",
    f"""SELECT doc_id, page, line_no, below_no, rank FROM (SELECT a.doc_id, a.page, a.line_no, b.line_no AS below_no, row_number() OVER (PARTITION BY a.doc_id, a.page, a.line_no ORDER BY b.y0, b.line_no) AS rank
    FROM {PL} a JOIN {PL} b ON a.doc_id = b.doc_id AND a.page = b.page AND b.y0 >= a.y1 AND b.y0 <= a.y1 + 40 AND b.x0 < a.x1 AND a.x0 < b.x1) WHERE rank <= 4""",
)
def lines_below(spark: SparkSession, d: str) -> DataFrame:
    return T.lines_below(_lines(spark, d))


_SEC = r"^[0-9]+(\.[0-9]+)* [A-Z]"


@add(
    "text_between_headings",
    rf"""WITH l AS (SELECT doc_id, CAST(page AS BIGINT) * 10000 + line_no AS pos, text FROM {PL} WHERE size >= 11 OR NOT regexp_matches(text, '{_SEC}')), h AS (SELECT doc_id, pos AS start, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS "end" FROM l WHERE regexp_matches(text, '{_SEC}'))
    SELECT h.doc_id, h.start, count(l.pos) AS n_lines, sum(length(l.text)) AS n_chars FROM h JOIN l ON l.doc_id = h.doc_id AND l.pos > h.start AND (h."end" IS NULL OR l.pos < h."end") GROUP BY 1, 2""",
)
def text_between_headings(spark: SparkSession, d: str) -> DataFrame:
    line = _lines(spark, d).filter((F.col("size") >= 11) | ~F.col("text").rlike(_SEC)).select("doc_id", (F.col("page").cast("bigint") * 10000 + F.col("line_no")).alias("pos"), "text")
    # the section of a line is the last heading before it: a carried state, no range join
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("text").rlike(_SEC)
    at = line.withColumn("start", F.last(F.when(head, F.col("pos")), True).over(w)).filter(F.col("start").isNotNull() & ~head)
    return at.groupBy("doc_id", "start").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@add(
    "page_number_offset",
    rf"""WITH f AS (SELECT doc_id, page, TRY_CAST(regexp_extract(text, '([0-9]+)', 1) AS INTEGER) - page AS off FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, line_no DESC) AS n FROM {PL}) WHERE n = 1 AND regexp_matches(text, '^(Page |p\. ?|- |\[)?[0-9]+( of [0-9]+| -|\]| \|)?$')),
    g AS (SELECT doc_id, off, count(*) AS n FROM f GROUP BY 1, 2) SELECT doc_id, arg_max(off, (n, -off)) AS off, max(n) AS n FROM g GROUP BY 1""",
)
def page_number_offset(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y0"), F.desc("line_no"))
    last = _lines(spark, d).withColumn("n", F.row_number().over(w)).filter("n = 1").filter(F.col("text").rlike(r"^(Page |p\. ?|- |\[)?[0-9]+( of [0-9]+| -|\]| \|)?$"))
    g = last.groupBy("doc_id", (F.regexp_extract("text", "([0-9]+)", 1).cast("int") - F.col("page")).alias("off")).agg(F.count("*").alias("n"))
    return g.groupBy("doc_id").agg(F.max_by("off", F.struct("n", -F.col("off"))).alias("off"), F.max("n").alias("n"))


_RANGES = "SELECT o_orderkey AS doc_id, concat(CAST(o_custkey % 9 + 1 AS {s}), '-', CAST(o_custkey % 9 + 1 + o_orderkey % 4 AS {s}), ', ', CAST(o_custkey % 5 AS {s})) AS t FROM {o}"


@add("number_ranges", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(range(CAST(string_split(string_split(t, ', ')[1], '-')[1] AS INTEGER), CAST(string_split(string_split(t, ', ')[1], '-')[2] AS INTEGER) + 1), [CAST(string_split(t, ', ')[2] AS INTEGER)]))), ' ') AS numbers FROM ({_RANGES.format(s='VARCHAR', o='orders')})")
def number_ranges(spark: SparkSession, d: str) -> DataFrame:
    t = spark.sql(_RANGES.format(s="STRING", o="{orders}"), orders=table(spark, d, "orders"))
    return t.select("doc_id", F.array_join(T.expanded(F.col("t")), " ").alias("numbers"))


_YEARS = "SELECT o_orderkey AS doc_id, concat(CAST(1990 + o_custkey % 30 AS {s}), 'a,b', CASE WHEN o_orderkey % 2 = 0 THEN ', 2001' ELSE '' END) AS t FROM {o}"


@add("citation_years", f"SELECT doc_id, left(t, 4) || 'a ' || left(t, 4) || 'b' || CASE WHEN doc_id % 2 = 0 THEN ' 2001' ELSE '' END AS years FROM ({_YEARS.format(s='VARCHAR', o='orders')})")
def citation_years(spark: SparkSession, d: str) -> DataFrame:
    t = spark.sql(_YEARS.format(s="STRING", o="{orders}"), orders=table(spark, d, "orders"))
    return t.select("doc_id", F.array_join(T.year_letters(F.col("t")), " ").alias("years"))


@add("supplement_identifiers", "SELECT DISTINCT c.token FROM (SELECT DISTINCT upper(left(p_name, 1)) || '.' || CAST(p_size % 7 AS VARCHAR) AS token FROM part) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT upper(left(s_name, 1)) || '.' || CAST(s_nationkey % 5 AS VARCHAR) || '.1' AS id FROM supplier) s WHERE s.id = c.token OR starts_with(s.id, c.token || '.'))")
def supplement_identifiers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit("."), (F.col("p_size") % 7).cast("string")).alias("token")).distinct()
    ids = table(spark, d, "supplier").select(F.concat(F.upper(F.substring("s_name", 1, 1)), F.lit("."), (F.col("s_nationkey") % 5).cast("string"), F.lit(".1")).alias("id")).distinct()
    # every prefix of an id is a key, so that the prefix test is an equal anti-join
    parts = F.split("id", r"\.")
    keys = ids.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("token")).distinct()
    return c.join(keys, "token", "left_anti")


@add(
    "identifier_fallback",
    """SELECT e.entry_id, coalesce(lower(e.doi), min(lower(p.doi)), min(lower(r.doi))) AS doi, CASE WHEN e.doi IS NOT NULL THEN 'printed' WHEN min(p.doi) IS NOT NULL THEN 'papers' WHEN min(r.doi) IS NOT NULL THEN 'records' END AS via
    FROM (SELECT DISTINCT entry_id, doi, lower(title) AS t FROM bib_entries) e LEFT JOIN (SELECT lower(title) AS t, min(doi) AS doi FROM papers WHERE doi IS NOT NULL GROUP BY 1) p ON p.t = e.t LEFT JOIN (SELECT lower(title) AS t, min(doi) AS doi FROM records WHERE doi IS NOT NULL GROUP BY 1) r ON r.t = e.t GROUP BY e.entry_id, e.doi""",
)
def identifier_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "bib_entries").select("entry_id", "doi", F.lower("title").alias("t")).distinct()
    one = lambda t: table(spark, d, t).filter("doi IS NOT NULL").groupBy(F.lower("title").alias("t")).agg(F.min("doi").alias(f"{t}_doi"))
    j = e.join(one("papers"), "t", "left").join(one("records"), "t", "left")
    via = F.when(F.col("doi").isNotNull(), "printed").when(F.col("papers_doi").isNotNull(), "papers").when(F.col("records_doi").isNotNull(), "records")
    return j.select("entry_id", F.lower(F.coalesce("doi", "papers_doi", "records_doi")).alias("doi"), via.alias("via"))


_D = "sqrt(pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2))"
_M = " + ".join(f"pow({m[0]} * (a.r - b.r) + {m[1]} * (a.g - b.g) + {m[2]} * (a.b - b.b), 2)" for m in T.DEUTERANOPIA)
_COLS = f"(SELECT doc_id, r, g, b, min(box_no) AS box_no FROM {duck('boxes')} GROUP BY 1, 2, 3, 4)"


@add("figure_color_vision", f"SELECT doc_id, box_a, box_b, round(before, 6) AS before, round(after, 6) AS after FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY box_a, box_b) AS n FROM (SELECT a.doc_id, a.box_no AS box_a, b.box_no AS box_b, {_D} AS before, sqrt({_M}) AS after FROM {_COLS} a JOIN {_COLS} b ON a.doc_id = b.doc_id AND a.box_no < b.box_no) WHERE round(before, 6) >= 0.25 AND round(after, 6) < 0.12) WHERE n = 1")
def figure_color_vision(spark: SparkSession, d: str) -> DataFrame:
    return T.colour_pairs(projection(spark, d, "boxes"))


@add("box_hues", f"""SELECT doc_id, box_no, round(CASE WHEN c = 0 THEN NULL WHEN hi = r THEN ((((g - b) / c) * 60) % 360 + 360) % 360 WHEN hi = g THEN ((b - r) / c + 2) * 60 ELSE ((r - g) / c + 4) * 60 END, 4) AS hue FROM (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS c FROM {duck("boxes")})""")
def box_hues(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "boxes").select("doc_id", "box_no", F.round(T.hue(F.col("r"), F.col("g"), F.col("b")), 4).alias("hue"))


@add("repeated_images", f"SELECT doc_id, digest, n, dpi FROM (SELECT doc_id, md5(concat(CAST(x1 - x0 AS VARCHAR), CAST(box_no % 3 AS VARCHAR))) AS digest, count(*) OVER (PARTITION BY doc_id, md5(concat(CAST(x1 - x0 AS VARCHAR), CAST(box_no % 3 AS VARCHAR)))) AS n, 72.0 * (box_no % 500) / (x1 - x0) AS dpi FROM {duck('boxes')}) WHERE n <= 3 AND dpi < 150")
def repeated_images(spark: SparkSession, d: str) -> DataFrame:
    b = projection(spark, d, "boxes").withColumn("digest", F.md5(F.concat((F.col("x1") - F.col("x0")).cast("string"), (F.col("box_no") % 3).cast("string"))))
    n = b.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "digest"))).withColumn("dpi", 72.0 * (F.col("box_no") % 500) / (F.col("x1") - F.col("x0")))
    return n.filter("n <= 3 AND dpi < 150").select("doc_id", "digest", "n", "dpi")


_REPLY = """SELECT o_orderkey AS doc_id, concat('audit_', CAST(o_custkey % 5 AS {s})) AS check_id, CASE WHEN o_orderkey % 7 = 0 THEN 'no json here' ELSE concat('words {{"issues": [{{"severity": "low", "text": "a', CAST(o_custkey AS {s}), '"}}, {{"severity": "high", "text": "b"}}, {{"severity": "medium", "text": "c"}}, {{"severity": "high", "text": "d"}}]}} more') END AS reply FROM {o}"""


@add(
    "audit_issues",
    f"""WITH r AS ({_REPLY.format(s="VARCHAR", o="orders")}), x AS (SELECT doc_id, check_id, reply, CASE WHEN json_valid(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1)) THEN CAST(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) AS JSON) END AS j FROM r),
    i AS (SELECT doc_id, check_id, k, j->>('$.issues[' || k || '].severity') AS severity, j->>('$.issues[' || k || '].text') AS text FROM x, generate_series(0, 3) g(k) WHERE j IS NOT NULL)
    SELECT doc_id, check_id, CAST(rank AS INTEGER) AS rank, severity, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, check_id ORDER BY list_position(['high', 'medium', 'low'], severity), k) AS rank FROM i) WHERE rank <= 3 UNION ALL SELECT doc_id, check_id, 0, 'skipped', NULL FROM x WHERE j IS NULL""",
)
def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    return T.issues(spark.sql(_REPLY.format(s="STRING", o="__orders").replace("{", "{{").replace("}", "}}").replace("__orders", "{orders}"), orders=table(spark, d, "orders")))


@add("module_semi_join", "SELECT DISTINCT c.module, c.check_id FROM (VALUES ('core.prose', 'a'), ('core.fonts', 'b'), ('llm.audit', 'c'), ('arr', 'd')) c(module, check_id) WHERE EXISTS (SELECT 1 FROM (VALUES ('core'), ('arr'), ('llm.prose')) m(m) WHERE c.module = m.m OR starts_with(c.module, m.m || '.'))")
def module_semi_join(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([("core.prose", "a"), ("core.fonts", "b"), ("llm.audit", "c"), ("arr", "d")], "module string, check_id string")
    m = spark.createDataFrame([("core",), ("arr",), ("llm.prose",)], "m string")
    parts = F.split("module", r"\.")
    return c.withColumn("m", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))).join(m, "m", "left_semi").select("module", "check_id").distinct()


_NUM = r"[0-9]+\.[0-9]+"


@add("section_numbers_missing", f"SELECT DISTINCT a.paper_id, a.v FROM (SELECT paper_id, unnest(regexp_extract_all(text, '{_NUM}')) AS v FROM documents WHERE section = 'intro' AND paper_id IS NOT NULL) a WHERE EXISTS (SELECT 1 FROM documents x WHERE x.paper_id = a.paper_id AND x.section = 'results' AND x.text IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM (SELECT paper_id, unnest(regexp_extract_all(text, '{_NUM}')) AS v FROM documents WHERE section = 'results') b WHERE b.paper_id = a.paper_id AND b.v = a.v)")
def section_numbers_missing(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").filter("paper_id IS NOT NULL AND text IS NOT NULL")
    nums = lambda s: doc.filter(F.col("section") == s).select("paper_id", F.explode(F.regexp_extract_all("text", F.lit(_NUM), 0)).alias("v")).distinct()
    return nums("intro").join(doc.filter("section = 'results'").select("paper_id").distinct(), "paper_id", "left_semi").join(nums("results"), ["paper_id", "v"], "left_anti")


@add(
    "segmented_bibliography",
    r"""WITH e AS (SELECT DISTINCT ON (entry_id) * FROM bib_entries WHERE raw IS NOT NULL), l AS (SELECT doc_id, entry_no * 1000 + generate_subscripts(x, 1) AS pos, unnest(x) AS text FROM (SELECT doc_id, entry_no, string_split(raw, chr(10)) AS x FROM e)),
    s AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^\s*\[[0-9]+\]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM l) SELECT doc_id, entry, md5(replace(regexp_replace(string_agg(text, chr(10) ORDER BY pos), '([0-9A-Za-z_])-\n', '\1', 'g'), chr(10), ' ')) AS digest FROM s WHERE entry > 0 GROUP BY 1, 2""",
)
def segmented_bibliography(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "bib_entries").dropDuplicates(["entry_id"]).filter("raw IS NOT NULL")
    lines = e.select("doc_id", "entry_no", F.posexplode(F.split("raw", "\n")).alias("k", "text")).select("doc_id", (F.col("entry_no") * 1000 + F.col("k") + 1).alias("pos"), "text")
    return T.segmented(lines).select("doc_id", "entry", F.md5("text").alias("digest"))


@add("hit_contexts", "SELECT doc_id, strpos(text, 'Table 1') AS at FROM documents WHERE contains(text, 'Table 1')")
def hit_contexts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.col("text").contains("Table 1"))
    return t.select("doc_id", F.locate("Table 1", "text").cast("bigint").alias("at"))
