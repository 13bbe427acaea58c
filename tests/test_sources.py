"""Source mappers on literal texts."""

from pyspark.sql import functions as F

from quire.sources import bibliographic as B


def _one(spark, reader, *texts, schema="text string"):
    return reader(spark.createDataFrame([(t,) for t in texts], schema)).orderBy("record_id").collect()


def test_bibtex(spark):
    text = '@article{k1,\n author = {Doe, Jane and {R.} Roe},\n title = {A {Nested} Title},\n year = 2012, pages = "1--9", journal={J}}\n\n@misc{k2, title={No authors}}\n@book{k3, author="A B", title="T", year={n.d.}}'
    rows = _one(spark, B.bibtex, text, None, "")
    assert [(r.record_id, r.title, r.authors, r.year, r.pages) for r in rows] == [("k1", "A Nested Title", ["Doe, Jane", "R. Roe"], 2012, "1-9"), ("k3", "T", ["A B"], None, None)]


def test_atom(spark):
    feed = "<feed><entry><id>http://arxiv.org/abs/2005.14165v4</id><title>A\n  B &amp; C</title><published>2020-05-28T</published><author><name>X Y</name></author><author><name>Z</name></author><arxiv:doi xmlns='x'>10.1/Q</arxiv:doi></entry></feed>"
    (r,) = _one(spark, B.atom, feed, "<feed/>", None)
    assert (r.record_id, r.title, r.authors, r.year, r.doi, r.preprint) == ("2005.14165", "A B & C", ["X Y", "Z"], 2020, "10.1/q", True)


def test_sparql_orders_authors(spark):
    b = lambda o, n: f'{{"pub":{{"value":"u"}},"title":{{"value":"T."}},"name":{{"value":"{n}"}},"ord":{{"value":"{o}"}},"year":{{"value":"2001"}}}}'
    (r,) = _one(spark, B.sparql, f'{{"results":{{"bindings":[{b(2, "B")},{b(1, "A")},{b(10, "C")}]}}}}', "broken")
    assert (r.title, r.authors, r.year) == ("T", ["A", "B", "C"], 2001)


def test_json_mappers(spark):
    (c,) = _one(spark, B.crossref, '{"DOI":"10.1/A","title":["T"],"subtitle":["S"],"author":[{"given":"G","family":"F"},{"literal":"Org"}],"issued":{"date-parts":[[2019,1]]},"type":"posted-content"}', "{}", None)
    assert (c.title, c.authors, c.year, c.preprint) == ("T: S", ["G F", "Org"], 2019, True)
    (o,) = _one(spark, B.openalex, '{"id":"W1","display_name":"T","type":"article","biblio":{"first_page":"1","last_page":"9"},"primary_location":{"source":{"type":"repository"}}}')
    assert (o.pages, o.preprint) == ("1-9", True)
    (v,) = _one(spark, B.openreview, '{"id":"n","pdate":1577836800000,"content":{"title":{"value":"T"},"venue":{"value":"Submitted to X"}}}')
    assert (v.year, v.preprint) == (2020, True)
    (w,) = _one(spark, B.openlibrary, '{"key":"/works/1","title":"T","subtitle":"S","publish_year":[2003,1999]}')
    assert (w.title, w.year, w.preprint) == ("T: S", 1999, False)
    (s,) = _one(spark, B.semantic_scholar, '{"paperId":"p","title":"T","externalIds":{"DOI":"10.2/X"}}')
    assert s.doi == "10.2/x"


def test_html_meta_and_liveness(spark):
    html = "<META NAME='citation_title' content='A &lt; B'><meta content=\"X\" name=\"citation_author\"><meta name='citation_author' content='Y'><meta name='citation_date' content='2011/02'>"
    (r,) = B.html_meta(spark.createDataFrame([("u", html), ("v", "<html>"), ("w", None)], "url string, html string")).collect()
    assert (r.title, r.authors, r.year) == ("A < B", ["X", "Y"], 2011)
    df = spark.createDataFrame([(200, True), (403, True), (404, True), (500, True), (200, False)], "s int, a boolean")
    assert [x[0] for x in df.select(B.liveness(F.col("s"), F.col("a"))).collect()] == ["ok", "blocked", "dead", "unknown", "unknown"]


def test_every_line_item_is_a_box(spark, tmp_path):
    from quire.sources.projections import projection

    spark.range(1, 8).selectExpr("1L AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id AS INT) AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.box_no for r in projection(spark, str(tmp_path), "boxes").collect()) == [i * 10001 for i in range(1, 8)]
