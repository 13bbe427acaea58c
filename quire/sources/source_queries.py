"""The source mappers over texts made from the test tables, against direct selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.querybook import book
from quire.sources import bibliographic as B
from quire.sources.tables import table

QUERIES, ORACLE, add = book()
_CLEAN = "regexp_replace(title, '[{}\"]', '', 'g')"
_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").withColumn("title", F.regexp_replace("title", r'[{}"]', "")).withColumn("names", F.from_json("authors", "array<string>"))


def _short(df: DataFrame) -> DataFrame:
    return df.select("record_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "pages")


_A = "array_to_string(from_json(authors, '[\"VARCHAR\"]'), '; ')"


@add("bibtex_source", f"SELECT id AS record_id, {_WS.format(_CLEAN)} AS title, {_A} AS authors, year, {_WS.format('@@')} AS venue, regexp_replace({_WS.format('pages')}, '-+', '-', 'g') AS pages FROM papers".replace("@@", "regexp_replace(venue, '[{}]', '', 'g')"))
def bibtex_source(spark: SparkSession, d: str) -> DataFrame:
    field = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {n} = {{"), c, F.lit("},\n"))).otherwise(F.lit(""))
    p = _papers(spark, d)
    text = F.concat(
        F.lit("@inproceedings{"), "id", F.lit(",\n"), field("title", F.col("title")), field("author", F.array_join("names", " and ")), field("year", F.col("year").cast("string")),
        field("booktitle", F.col("venue")), field("pages", F.col("pages")), F.lit("}\n"),
    )
    return _short(B.bibtex(p.select(text.alias("text"))))


@add("crossref_source", f"SELECT lower(doi) AS record_id, {_CLEAN} AS title, {_A} AS authors, year, venue, pages FROM papers WHERE starts_with(doi, '10.') AND contains(doi, '/')")
def crossref_source(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).filter("startswith(doi, '10.') AND contains(doi, '/')")
    text = F.to_json(
        F.struct(
            F.col("doi").alias("DOI"), F.array("title").alias("title"), F.transform("names", lambda n: F.struct(n.alias("literal"))).alias("author"),
            F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.array("venue").alias("container-title"), F.col("pages").alias("page"), F.lit("proceedings-article").alias("type"),
        )
    )
    return _short(B.crossref(p.select(text.alias("text"))))


@add("openalex_source", f"SELECT id AS record_id, {_CLEAN} AS title, {_A} AS authors, year, venue, pages FROM papers")
def openalex_source(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(
        F.struct(
            F.col("id"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.transform("names", lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))).alias("authorships"),
            F.struct(F.col("pages").alias("first_page")).alias("biblio"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        )
    )
    return _short(B.openalex(_papers(spark, d).select(text.alias("text"))))


@add("sparql_source", f"SELECT id AS record_id, regexp_replace({_CLEAN}, '\\.$', '') AS title, {_A} AS authors, year, venue, pages FROM papers")
def sparql_source(spark: SparkSession, d: str) -> DataFrame:
    v = lambda c, n: F.struct(c.alias("value")).alias(n)
    binding = F.transform("names", lambda n, i: F.struct(v(F.col("id"), "pub"), v(F.col("title"), "title"), v(n, "name"), v(i.cast("string"), "ord"), v(F.col("year").cast("string"), "year"), v(F.col("venue"), "venue"), v(F.col("pages"), "pages")))
    text = F.to_json(F.struct(F.struct(binding.alias("bindings")).alias("results")))
    return _short(B.sparql(_papers(spark, d).select(text.alias("text"))))


@add("html_meta_source", f"SELECT id AS record_id, replace({_CLEAN}, '''', '') AS title, replace({_A}, '''', '') AS authors, year, venue FROM papers")
def html_meta_source(spark: SparkSession, d: str) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("'"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    meta = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f'<meta content="'), esc(c), F.lit(f'" name="citation_{n}">'))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head>"), meta("title", F.col("title")), F.array_join(F.transform("names", lambda n: meta("author", n)), ""), meta("publication_date", F.col("year").cast("string")), meta("conference_title", F.col("venue")), F.lit("</head></html>"))
    return _short(B.html_meta(_papers(spark, d).select(F.col("id").alias("url"), html.alias("html")))).drop("pages")


@add("semantic_scholar_source", f"SELECT id AS record_id, {_CLEAN} AS title, {_A} AS authors, year, venue, CAST(NULL AS VARCHAR) AS pages FROM papers")
def semantic_scholar_source(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("id").alias("paperId"), "title", "year", "venue", F.transform("names", lambda n: F.struct(n.alias("name"))).alias("authors")))
    return _short(B.semantic_scholar(_papers(spark, d).select(text.alias("text"))))
