"""Headings of any kind, sections by their names, and where these stand in a document.

All of it is keyed by document and ordered by (page, line_no); the only joins are
with tables of one row a document.  Rows delivered twice and null texts are no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles of sections, by kind.
SECTIONS = {
    "limitations": ["Limitations", "Limitation"],
    "references": ["References", "Bibliography"],
    "appendix": ["Appendix", "Appendices", "Supplementary Material", "Supplemental Material"],
    "acknowledgments": ["Acknowledgments", "Acknowledgements", "Acknowledgment", "Acknowledgement"],
    "ethics": ["Ethics Statement", "Ethical Considerations", "Ethical Statement", "Broader Impact", "Broader Impacts"],
}
#: A heading's number (a letter alone needs its stop) and its title.
NUMBERED = r"^(?:(\d+(?:\.\d+)*|[A-Z](?:\.\d+)+|[A-Z](?=\.\s))\.?\s+)?(\p{Lu}.*)$"
CAPTION = r"^(Figure|Fig\.|Table|Algorithm|Listing)\s+([A-Z]?\.?\d+(?:\.\d+)?)\s*[:.]"
LONGEST, SHORTEST, MOST_WORDS, LARGER = 90, 3, 14, 0.4


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the size in which most letters of a document stand, ties to the smaller."""
    sums = lines.groupBy("doc_id", "size").agg(F.sum(F.length(F.trim("text"))).alias("w"))
    return sums.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))


def normal(title: Column) -> Column:
    """Letters a-z and spaces of a title in lower case."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z ]", ""))


def outline(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, numbering, title, normal) of the headings, numbered or not: short, beginning with a
    capital, no caption, without an end mark, and bold or larger than the body text; numbering is null where there is none."""
    text = F.trim("text")
    shape = (F.length(text) <= LONGEST) & (F.length(text) >= SHORTEST) & ~text.rlike(r"[.,;:]$") & ~text.rlike(CAPTION) & text.rlike(NUMBERED) & (F.size(F.split(text, r"\s+")) <= MOST_WORDS)
    set_off = F.coalesce("bold", F.lit(False)) | (F.col("size") >= F.col("body") + LARGER)
    own = lines.filter("text IS NOT NULL")
    title = F.trim(F.regexp_extract(text, NUMBERED, 2))
    return own.join(body_size(own), "doc_id").filter(shape & set_off).select("doc_id", "page", "line_no", F.nullif(F.regexp_extract(text, NUMBERED, 1), F.lit("")).alias("numbering"), title.alias("title"), normal(title).alias("normal"))


def sections(headings: DataFrame, kinds: dict[str, list[str]] = SECTIONS) -> DataFrame:
    """(doc_id, kind, page, line_no, numbering, title): the first heading of each kind of section; one of the
    section level goes before one with a dotted number."""
    names = [(kind, a) for kind, aliases in kinds.items() for a in {x.lower() for x in aliases}]
    wanted = headings.sparkSession.createDataFrame(names, "kind string, normal string")  # a few names: bounded
    dotted = F.coalesce(F.contains("numbering", F.lit(".")), F.lit(False))
    met = headings.join(F.broadcast(wanted), "normal")
    row = F.struct("page", "line_no", "numbering", "title")
    best = met.groupBy("doc_id", "kind").agg(F.min_by(row, F.struct(dotted, "page", "line_no")).alias("h"))
    return best.select("doc_id", "kind", "h.*")


def placed(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """One row a document: last page, and struct (page, line_no, numbering, title) of each kind of section, null where there is none."""
    row = F.struct("page", "line_no", "numbering", "title")
    wide = sections(headings).groupBy("doc_id").pivot("kind", list(SECTIONS)).agg(F.first(row))
    return lines.groupBy("doc_id").agg(F.max("page").alias("pages")).join(wide, "doc_id", "left")


def _at(kind: str) -> Column:
    return F.struct(F.col(f"{kind}.page"), F.col(f"{kind}.line_no"))


def findings(docs: DataFrame, headings: DataFrame, limit: int) -> DataFrame:
    """(doc_id, check, severity, page): presence, place and order of the sections, and the pages before the first
    section that no limit counts (``limit`` pages are allowed)."""
    lim, ref, app = (F.col(k).isNotNull() for k in ("limitations", "references", "appendix"))
    present = F.when(~lim, "error").when(F.lower("limitations.title") != "limitations", "warning").when(F.col("limitations.numbering").isNotNull(), "warning").otherwise("pass")
    between = docs.filter(lim & ref).select("doc_id", _at("limitations").alias("a"), _at("references").alias("b")).join(headings.filter(F.col("numbering").rlike(r"^\d")), "doc_id")
    trailing = between.filter((F.struct("page", "line_no") > F.col("a")) & (F.struct("page", "line_no") < F.col("b"))).groupBy("doc_id").agg(F.count("*").alias("trailing"))
    d = docs.join(trailing, "doc_id", "left")
    position = F.when(~lim, None).when(~ref, "warning").when(_at("limitations") > _at("references"), "error").when(F.col("trailing") > 0, "warning").otherwise("pass")
    appendix = F.when(~app, "pass").when(~ref, "warning").when(_at("appendix") < _at("references"), "error").otherwise("pass")
    first = F.array_min(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), _at(k)) for k in SECTIONS])))
    # a section that starts on a page's first line leaves that page to what follows
    content = F.coalesce(F.when(first["line_no"] <= 1, first["page"] - 1).otherwise(first["page"]), F.col("pages"))
    checks = [
        ("limitations_present", present, F.col("limitations.page")),
        ("limitations_position", position, F.col("limitations.page")),
        ("references_position", F.when(ref, "pass").otherwise("warning"), F.col("references.page")),
        ("appendix_position", appendix, F.col("appendix.page")),
        ("page_limit", F.when(content > limit, "error").otherwise("pass"), content),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("severity"), p.alias("page")) for n, s, p in checks])).alias("f")
    return d.select("doc_id", rows).select("doc_id", "f.*").filter("severity IS NOT NULL")
