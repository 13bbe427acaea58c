"""Bibliographic sources as DataFrames of raw text mapped to one record schema.

Each reader takes a DataFrame with the source's text and gives
``RECORD_COLUMNS``; malformed texts give no record.  Fetching is left to whoever
fills the tables: the mappers are pure and run on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import normalised_doi

RECORD_COLUMNS = ["record_id", "title", "authors", "year", "venue", "doi", "pages", "url", "preprint"]


def _record(df: DataFrame, **cols: Column) -> DataFrame:
    nulls = {"authors": "array<string>", "year": "int", "preprint": "boolean"}
    return df.select(*[(cols[c] if c in cols else F.lit(None).cast(nulls.get(c, "string"))).alias(c) for c in RECORD_COLUMNS])


def bibtex(texts: DataFrame, text: str = "text") -> DataFrame:
    """Entries of BibTeX text (one or many a row) that have a title and authors."""
    entries = texts.select(F.explode(F.split(F.concat(F.lit("\n"), text), r"\n\s*@(?=\w+\s*\{)")).alias("e")).filter(F.col("e").rlike(r"^\s*\w+\s*\{\s*[^,\s]+\s*,"))

    def field(name: str) -> Column:
        braced = F.regexp_extract("e", rf"(?is)[\s,{{]{name}\s*=\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", 1)
        quoted = F.regexp_extract("e", rf'(?is)[\s,{{]{name}\s*=\s*"([^"]*)"', 1)
        bare = F.regexp_extract("e", rf"(?is)[\s,{{]{name}\s*=\s*(\d+)", 1)
        raw = F.coalesce(F.nullif(braced, F.lit("")), F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit("")))
        return F.trim(F.regexp_replace(F.regexp_replace(raw, r"[{}]", ""), r"\s+", " "))

    authors = F.split(field("author"), r"\s+and\s+")
    key = F.regexp_extract("e", r"^\s*\w+\s*\{\s*([^,\s]+)\s*,", 1)
    out = _record(
        entries, record_id=key, title=field("title"), authors=authors, year=field("year").try_cast("int"), venue=F.coalesce(field("booktitle"), field("journal")),
        doi=normalised_doi(field("doi")), pages=F.regexp_replace(field("pages"), "-+", "-"), url=field("url"),
    )
    return out.filter("title IS NOT NULL AND authors IS NOT NULL")


def atom(feeds: DataFrame, text: str = "text") -> DataFrame:
    """Entries of Atom feeds."""
    entries = feeds.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("e"))

    def tag(name: str) -> Column:
        return F.nullif(_unescaped(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"\s+", " "))), F.lit(""))

    names = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), 1), _unescaped)
    key = F.regexp_extract("e", r"<id>\s*(?:https?://arxiv\.org/abs/)?([^<\s]+?)(?:v\d+)?\s*</id>", 1)
    return _record(
        entries, record_id=key, title=tag("title"), authors=names, year=F.substring(tag("published"), 1, 4).try_cast("int"), venue=F.coalesce(tag("arxiv:journal_ref"), F.lit("arXiv")),
        doi=normalised_doi(tag("arxiv:doi")), url=F.nullif(F.regexp_extract("e", r"<id>\s*([^<\s]+)\s*</id>", 1), F.lit("")), preprint=F.lit(True),
    ).filter("title IS NOT NULL")


def _unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sparql(results: DataFrame, text: str = "text") -> DataFrame:
    """Rows of SPARQL JSON results, one an author, grouped to publications (authors by ordinal)."""
    v = "struct<value:string>"
    kind = f"struct<results:struct<bindings:array<struct<pub:{v},title:{v},name:{v},ord:{v},year:{v},venue:{v},doi:{v},pages:{v}>>>>"
    rows = results.select(F.explode(F.from_json(text, kind)["results"]["bindings"]).alias("b"))
    g = rows.groupBy(F.col("b.pub.value").alias("record_id")).agg(
        *[F.first(F.col(f"b.{c}.value"), True).alias(c) for c in ("title", "year", "venue", "doi", "pages")],
        F.array_sort(F.collect_set(F.struct(F.col("b.ord.value").try_cast("int").alias("o"), F.col("b.name.value").alias("n")))).alias("names"),
    )
    return _record(g, record_id=F.col("record_id"), title=F.regexp_replace("title", r"\.$", ""), authors=F.col("names.n"), year=F.col("year").try_cast("int"), venue=F.col("venue"), doi=normalised_doi(F.col("doi")), pages=F.col("pages"), url=F.col("record_id"))


def crossref(items: DataFrame, text: str = "text") -> DataFrame:
    """CrossRef works: title and subtitle joined, literal or given and family names, posted content is a preprint."""
    kind = "struct<DOI:string,title:array<string>,subtitle:array<string>,author:array<struct<literal:string,given:string,family:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,page:string,URL:string,type:string>"
    w = items.select(F.from_json(text, kind).alias("w")).filter(F.size("w.title") > 0)
    sub = F.try_element_at(F.col("w.subtitle"), F.lit(1))
    title = F.when(sub.isNotNull() & (sub != ""), F.concat_ws(": ", F.col("w.title")[0], sub)).otherwise(F.col("w.title")[0])
    names = F.transform("w.author", lambda a: F.coalesce(a["literal"], a["name"], F.concat_ws(" ", a["given"], a["family"])))
    return _record(
        w, record_id=normalised_doi(F.col("w.DOI")), title=title, authors=names, year=F.try_element_at(F.try_element_at(F.col("w.issued.`date-parts`"), F.lit(1)), F.lit(1)), venue=F.try_element_at(F.col("w.`container-title`"), F.lit(1)),
        doi=normalised_doi(F.col("w.DOI")), pages=F.col("w.page"), url=F.col("w.URL"), preprint=F.col("w.type") == "posted-content",
    )


def openalex(items: DataFrame, text: str = "text") -> DataFrame:
    """OpenAlex works: first and last page joined, a repository's location is a preprint."""
    kind = "struct<id:string,display_name:string,publication_year:int,doi:string,type:string,authorships:array<struct<author:struct<display_name:string>>>,biblio:struct<first_page:string,last_page:string>,primary_location:struct<landing_page_url:string,source:struct<display_name:string,type:string>>>"
    w = items.select(F.from_json(text, kind).alias("w")).filter("w.display_name IS NOT NULL")
    src = F.col("w.primary_location.source")
    pages = F.when(F.col("w.biblio.first_page").isNotNull(), F.concat_ws("-", "w.biblio.first_page", "w.biblio.last_page"))
    return _record(
        w, record_id=F.col("w.id"), title=F.col("w.display_name"), authors=F.col("w.authorships.author.display_name"), year=F.col("w.publication_year"), venue=src["display_name"],
        doi=normalised_doi(F.col("w.doi")), pages=pages, url=F.col("w.primary_location.landing_page_url"), preprint=(F.col("w.type") == "preprint") | F.coalesce(src["type"] == "repository", F.lit(False)),
    )


def openreview(items: DataFrame, text: str = "text") -> DataFrame:
    """OpenReview notes: wrapped values, not accepted ones are preprints, years from milliseconds."""
    kind = "struct<id:string,cdate:bigint,pdate:bigint,content:struct<title:struct<value:string>,authors:struct<value:array<string>>,venue:struct<value:string>,venueid:struct<value:string>>>"
    w = items.select(F.from_json(text, kind).alias("w")).filter("w.content.title.value IS NOT NULL")
    venue, vid = F.coalesce(F.col("w.content.venue.value"), F.lit("")), F.coalesce(F.lower("w.content.venueid.value"), F.lit(""))
    out = F.lower(venue).startswith("submitted to") | vid.rlike("withdrawn|rejected|archive|submission")
    year = F.year(F.timestamp_millis(F.coalesce("w.pdate", "w.cdate")))
    return _record(w, record_id=F.col("w.id"), title=F.col("w.content.title.value"), authors=F.col("w.content.authors.value"), year=year, venue=F.nullif(venue, F.lit("")), url=F.concat(F.lit("https://openreview.net/forum?id="), "w.id"), preprint=out)


def openlibrary(items: DataFrame, text: str = "text") -> DataFrame:
    """Open Library search documents: title and subtitle joined, the first publish year, never a preprint."""
    w = items.select(F.from_json(text, "struct<key:string,title:string,subtitle:string,author_name:array<string>,publish_year:array<int>,publisher:array<string>>").alias("w")).filter("w.title IS NOT NULL")
    return _record(w, record_id=F.col("w.key"), title=F.concat_ws(": ", "w.title", F.nullif("w.subtitle", F.lit(""))), authors=F.col("w.author_name"), year=F.array_min("w.publish_year"), venue=F.try_element_at(F.col("w.publisher"), F.lit(1)), url=F.concat(F.lit("https://openlibrary.org"), "w.key"), preprint=F.lit(False))


def semantic_scholar(items: DataFrame, text: str = "text") -> DataFrame:
    """Semantic Scholar papers."""
    w = items.select(F.from_json(text, "struct<paperId:string,title:string,year:int,venue:string,url:string,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>").alias("w")).filter("w.title IS NOT NULL")
    return _record(w, record_id=F.col("w.paperId"), title=F.col("w.title"), authors=F.col("w.authors.name"), year=F.col("w.year"), venue=F.nullif(F.col("w.venue"), F.lit("")), doi=normalised_doi(F.col("w.externalIds.DOI")), url=F.col("w.url"))


def html_meta(pages: DataFrame, text: str = "html", url: str = "url") -> DataFrame:
    """Pages with citation meta tags (attributes in any order)."""
    tags = F.regexp_extract_all(F.substring(F.col(text), 1, 500_000), F.lit(r"(?is)<meta\s[^>]*>"), 0)

    def of(name: str) -> Column:
        mine = F.filter(tags, lambda t: t.rlike(rf"(?i)name\s*=\s*[\"']citation_{name}[\"']"))
        return F.transform(mine, lambda t: _unescaped(F.regexp_extract(t, r"(?i)content\s*=\s*[\"']([^\"']*)[\"']", 1)))

    first = lambda n: F.try_element_at(of(n), F.lit(1))
    pages_ = F.when(first("firstpage").isNotNull(), F.concat_ws("-", first("firstpage"), first("lastpage")))
    return _record(
        pages, record_id=F.col(url), title=first("title"), authors=of("author"), year=F.regexp_extract(F.coalesce(first("publication_date"), first("date"), F.lit("")), r"(\d{4})", 1).try_cast("int"),
        venue=F.coalesce(first("conference_title"), first("journal_title")), doi=normalised_doi(first("doi")), pages=pages_, url=F.col(url),
    ).filter("title IS NOT NULL")


def liveness(status: Column, allowed: Column) -> Column:
    """Whether a URL is alive: ok, blocked (alive but refused), dead or unknown."""
    return F.when(~allowed, "unknown").when(status < 400, "ok").when(status.isin(403, 405, 429), "blocked").when(status.isin(404, 410), "dead").otherwise("unknown")
