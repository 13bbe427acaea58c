"""Queries of headings and section structure, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators import outline as O
from quire.querybook import book
from quire.sources.projections import duck, projection

QUERIES, ORACLE, add = book()

#: Pages of content that the queries allow.
LIMIT = 8

_LINES = duck("outline_lines")
_OUTLINE = rf"""(SELECT doc_id, page, line_no, nullif(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)+|[A-Z]\.)\.?\s+\p{{Lu}}', 1), '') AS number, t FROM (SELECT l.*, trim(text) AS t, body FROM {_LINES} l
JOIN (SELECT doc_id, arg_max(size, (w, -size)) AS body FROM (SELECT doc_id, size, sum(length(trim(text))) AS w FROM {_LINES} GROUP BY 1, 2) GROUP BY 1) b ON l.doc_id = b.doc_id)
WHERE length(t) BETWEEN 3 AND 90 AND NOT regexp_matches(t, '[.,;:]$') AND NOT regexp_matches(t, '{O.CAPTION}') AND regexp_matches(t, '^(?:(?:[0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)+|[A-Z]\.)\.?\s+)?\p{{Lu}}')
AND len(string_split_regex(t, '\s+')) <= 14 AND (bold OR size >= body + 0.4))"""
_TITLED = f"(SELECT doc_id, page, line_no, rtrim(number, '.') AS numbering, trim(CASE WHEN number IS NULL THEN t ELSE regexp_replace(t, '^[^ ]+ +', '') END) AS title FROM {_OUTLINE})"
_NAMED = f"(SELECT *, trim(regexp_replace(lower(title), '[^a-z ]', '', 'g')) AS normal FROM {_TITLED})"
_KINDS = ", ".join(f"('{k}', '{a.lower()}')" for k, aliases in O.SECTIONS.items() for a in aliases)
_SECTIONS = f"""(SELECT doc_id, kind, page, line_no, numbering, title FROM (SELECT h.*, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY coalesce(contains(numbering, '.'), false), page, line_no) AS n
FROM {_NAMED} h JOIN (VALUES {_KINDS}) k(kind, alias) ON h.normal = k.alias) WHERE n = 1)"""


def _one(kind: str) -> str:
    return f"(SELECT * FROM {_SECTIONS} WHERE kind = '{kind}')"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "outline_lines")


@add("outline", f"SELECT * FROM {_NAMED}")
def outline(spark: SparkSession, d: str) -> DataFrame:
    return O.outline(_lines(spark, d))


@add("section_lookup", f"SELECT * FROM {_SECTIONS}")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    return O.sections(O.outline(_lines(spark, d)))


_FOUND = f"""WITH docs AS (SELECT doc_id, max(page) AS pages FROM {_LINES} GROUP BY 1), lim AS {_one("limitations")}, ref AS {_one("references")}, app AS {_one("appendix")}, heads AS {_NAMED},
first AS (SELECT doc_id, min(page) AS fp, arg_min(line_no, (page, line_no)) AS fl FROM {_SECTIONS} GROUP BY 1),
d AS (SELECT docs.doc_id, lim.page AS lp, lim.line_no AS ll, lim.numbering AS ln, lim.title AS lt, ref.page AS rp, ref.line_no AS rl, app.page AS ap, app.line_no AS al,
  CASE WHEN fp IS NULL THEN pages WHEN fl <= 1 THEN fp - 1 ELSE fp END AS content,
  (SELECT count(*) FROM heads h WHERE h.doc_id = docs.doc_id AND regexp_matches(h.numbering, '^[0-9]') AND (h.page, h.line_no) > (lim.page, lim.line_no) AND (h.page, h.line_no) < (ref.page, ref.line_no)) AS after_it
  FROM docs LEFT JOIN lim ON lim.doc_id = docs.doc_id LEFT JOIN ref ON ref.doc_id = docs.doc_id LEFT JOIN app ON app.doc_id = docs.doc_id LEFT JOIN first ON first.doc_id = docs.doc_id)"""
_CHECKS = {
    "limitations_present": ("CASE WHEN lp IS NULL THEN 'error' WHEN lower(lt) <> 'limitations' OR ln IS NOT NULL THEN 'warning' ELSE 'pass' END", "lp"),
    "limitations_position": ("CASE WHEN lp IS NULL THEN NULL WHEN rp IS NULL THEN 'warning' WHEN (lp, ll) > (rp, rl) THEN 'error' WHEN after_it > 0 THEN 'warning' ELSE 'pass' END", "lp"),
    "references_position": ("CASE WHEN rp IS NULL THEN 'warning' ELSE 'pass' END", "rp"),
    "appendix_position": ("CASE WHEN ap IS NULL THEN 'pass' WHEN rp IS NULL THEN 'warning' WHEN (ap, al) < (rp, rl) THEN 'error' ELSE 'pass' END", "ap"),
    "page_limit": (f"CASE WHEN content > {LIMIT} THEN 'error' ELSE 'pass' END", "content"),
}


def _check(name: str) -> None:
    severity, page = _CHECKS[name]

    @add(name, f"SELECT * FROM ({_FOUND} SELECT doc_id, {severity} AS severity, {page} AS page FROM d) WHERE severity IS NOT NULL")
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = _lines(spark, d)
        heads = O.outline(lines)
        return O.findings(O.placed(lines, heads), heads, LIMIT).filter(f"check = '{name}'").drop("check")


for _name in _CHECKS:
    _check(_name)
