"""Headings with and without numbers, sections by name, and their places."""

from quire.operators.outline import findings, outline, placed, sections

L = "doc_id long, page int, line_no int, text string, size double, bold boolean, title string"
BODY = "the text of a line that goes on and on over the page"


def _lines(spark):
    rows = [
        (1, 1, 1, "A Study of Things", 14.0, False), (1, 1, 2, "Abstract", 10.0, True), (1, 1, 3, BODY, 10.0, False), (1, 2, 1, "1 Introduction", 10.0, True),
        (1, 2, 2, "Figure 1: Things", 12.0, True), (1, 2, 3, "A bold sentence ends here.", 10.0, True), (1, 2, 4, "word " * 15, 12.0, True), (1, 2, 5, BODY, 10.0, None),
        (1, 3, 1, "2.1. References", 10.0, True), (1, 3, 5, "Limitations", 10.5, False), (1, 4, 1, "References", 10.0, True), (1, 4, 1, "References", 10.0, True), (1, 4, 2, BODY, 10.0, False),
        (2, 1, 1, "3 Limitations", 12.0, False), (2, 1, 2, BODY, 10.0, False), (2, 1, 3, "4 More", 12.0, False), (2, 1, 4, "B. Appendix", 12.0, False), (2, 2, 1, "References", 12.0, False), (2, 2, 2, None, 10.0, False),
        (3, 1, 1, BODY, 10.0, False),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], L)


def test_headings(spark):
    got = {(r.doc_id, r.page, r.line_no): (r.numbering, r.title) for r in outline(_lines(spark)).collect()}
    assert got[1, 1, 1] == (None, "A Study of Things") and got[1, 1, 2] == (None, "Abstract") and got[1, 2, 1] == ("1", "Introduction") and got[1, 3, 1] == ("2.1", "References")
    assert got[2, 1, 4] == ("B", "Appendix") and not {(1, 2, 2), (1, 2, 3), (1, 2, 4), (1, 2, 5)} & got.keys()


def test_section_level_goes_first(spark):
    got = {(r.doc_id, r.kind): (r.page, r.numbering) for r in sections(outline(_lines(spark))).collect()}
    assert got[1, "references"] == (4, None) and got[2, "appendix"] == (1, "B")


def test_findings(spark):
    lines = _lines(spark)
    heads = outline(lines)
    got = {(r.doc_id, r.check): (r.severity, r.page) for r in findings(placed(lines, heads), heads, 2).collect()}
    assert got[1, "limitations_present"] == ("pass", 3) and got[1, "limitations_position"] == ("pass", 3) and got[1, "page_limit"] == ("error", 3)
    assert got[2, "limitations_present"] == ("warning", 1) and got[2, "limitations_position"] == ("warning", 1) and got[2, "appendix_position"] == ("error", 1) and got[2, "page_limit"] == ("pass", 0)
    assert got[3, "limitations_present"] == ("error", None) and (3, "limitations_position") not in got and got[3, "references_position"] == ("warning", None)
    assert findings(placed(lines.limit(0), heads.limit(0)), heads.limit(0), 2).count() == 0
