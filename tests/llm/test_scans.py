"""Repair of scanned text on small pages, and its parts against plain versions."""

import itertools

import pytest

from quire.llm.scans import CONFUSIONS, Repair, deletions, explained

SPANS = "doc_id long, page int, line_no int, span_no int, y0 double, size double, text string, kind string"
LINES = "doc_id long, page int, line_no int, y0 double, size double, text string, col_no int"
BIB = "doc_id long, entry_no int, entry_id string, raw string, word string"

BODY = ["the authors of the corpus describe a transcript", "and the likelihood of zero-shot reference parsing", "while the recurrent encoder converges in 2007 steps"]


def _inputs(spark):
    spans = []
    for d in range(1, 7):
        for i in range(9):
            spans.append((d, 1, i + 1, 1, 60.0 + 12.5 * i, 10.0, BODY[i % 3] + " also", "x"))
    noisy = [
        "Workshop on Speech 2015 · WSPEE", "7 Large Things", "the auth0rs describe the likelihood of the tran-", "script and tbe re(urrent encoder in 2O07 while", "the zero-", "shot", "reference parsing of the encocler con¬",
    ]
    ys = [40.0, 60.0, 78.5, 91.0, 103.5, 116.0, 128.5]
    for i, (t, y) in enumerate(zip(noisy, ys, strict=True)):
        spans.append((50, 1, i + 1, 1, y, 12.0 if i == 1 else 10.0, t, "x"))
    spans.append((50, 1, 8, 1, 790.0, 10.0, "- l2 -", "x"))
    spans.append((50, 2, 1, 1, 40.0, 10.0, "Workshop on Speecb 2015 · WSPEE", "x"))
    spans += [(50, 2, 2, 1, 60.0, 10.0, "verges of the ", "x"), (50, 2, 2, 2, 60.0, 10.0, "corpus", "x"), (50, 2, 2, 2, 60.0, 10.0, "corpus", "x"), (50, 2, 3, 1, 72.5, 10.0, "12", "x"), (50, 2, 4, 1, 85.0, 10.0, "and the steps", "x")]
    spans += [(51, 1, 1, 1, 60.0, 10.0, None, "x"), (51, 1, 2, 1, 72.5, 10.0, "", "x")]
    pages = [(90, 1, 1, 60.0, 10.0, "the corpus of a transcr!pt", 0), (90, 1, 2, 72.5, 10.0, "and the encoder", 0), (90, 1, 2, 72.5, 10.0, "and the encoder", 0)]
    bib = [(7, 3, "b1", "[4] The like|ihood of the en-\nPage 5\ncoder, pages 20-\n12\nWSPEE 2015    13\nend.", "w"), (7, 4, "b2", None, "w")]
    return spark.createDataFrame(spans, SPANS), spark.createDataFrame(pages, LINES), spark.createDataFrame(bib, BIB)


def test_found(spark):
    got = {tuple(r) for r in Repair(*_inputs(spark)).found().collect()}
    assert got == {
        ("spans", 50, 1, 1, "header", ""), ("spans", 50, 2, 1, "header", ""), ("spans", 50, 1, 8, "folio", ""),
        ("spans", 50, 1, 3, "split", "transcript"), ("spans", 50, 1, 7, "split", "converges"),
        ("spans", 50, 1, 3, "misread", "authors"), ("spans", 50, 1, 4, "misread", "recurrent"), ("spans", 50, 1, 4, "misread", "2007"), ("spans", 50, 1, 7, "misread", "encoder"),
        ("page_lines", 90, 1, 1, "misread", "transcript"),
        ("bib_entries", 7, 0, 3, "split", "encoder"), ("bib_entries", 7, 0, 3, "misread", "likelihood"), ("bib_entries", 7, 0, 3, "folio", ""), ("bib_entries", 7, 0, 3, "header", ""),
    }


def test_empty(spark):
    s, p, b = _inputs(spark)
    assert Repair(s.limit(0), p.limit(0), b.limit(0)).found().count() == 0


@pytest.mark.parametrize(("read", "right", "cost"), [("docurnent", "document", 1), ("fi9ure", "figure", 1), ("c1ass", "class", 1), ("figiires", "figures", 1), ("same", "same", 0), ("table", "cable", None), ("!mag!ne", "imagine", 2)])
def test_explained(read, right, cost):
    assert explained(read, right) == cost


def test_deletions_meet_for_every_confusion():
    for (a, b), word in itertools.product(CONFUSIONS, ["x{}yz", "{}ab", "ab{}"]):
        assert deletions(word.format(a), [p for p, _ in CONFUSIONS], 1) & deletions(word.format(b), [r for _, r in CONFUSIONS], 1)


def test_join_beyond_the_held_size_gives_the_same(spark, monkeypatch):
    from quire.llm import scans

    want = sorted(map(tuple, Repair(*_inputs(spark)).found().collect()))
    monkeypatch.setattr(scans, "HELD", -1)
    assert sorted(map(tuple, Repair(*_inputs(spark)).found().collect())) == want


def test_paragraphs_run_on_over_lines_and_pages(spark):
    rows = {(r.tbl, r.doc_id, r.para): r.text for r in Repair(*_inputs(spark)).paragraphs().collect()}
    text = " ".join(rows[k] for k in sorted(rows) if k[:2] == ("spans", 50))
    assert text == (
        "7 Large Things the authors describe the likelihood of the transcript and tbe recurrent encoder in 2007 while the zero-shot reference parsing of the encoder converges of the corpus 12 and the steps"
    )
    assert rows["bib_entries", 7, 1] == "The likelihood of the encoder, pages 20-12 end."
    assert rows["page_lines", 90, 1].startswith("the corpus of a transcript")


def test_very_long_lines_and_words(spark):
    s, p, b = _inputs(spark)
    long = spark.createDataFrame([(60, 1, 1, 1, 60.0, 10.0, "w" * 200_000 + "-", "x"), (60, 1, 2, 1, 72.5, 10.0, "." * 200_000 + "a " + "tbe " * 20_000, "x")], SPANS)
    got = [r for r in Repair(s.unionByName(long), p, b).found().collect() if r.doc_id == 60]
    assert all(r.kind in ("split", "misread") for r in got)


def test_no_words_go_to_the_driver(spark, monkeypatch):
    """Workers hold hashes of words; another word of a hash that is held changes nothing."""
    from quire.llm import scans

    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", lambda *_: pytest.fail("rows on the driver"))
    made = Repair(*_inputs(spark))
    held = scans._held(made.right.select("word")).value
    assert len(held) and held.dtype == "int64"
    for r in made.right.collect():
        assert scans._among(held, r.word)
    assert not scans._among(held, "nowhere")
    want = sorted(map(tuple, made.found().collect()))
    monkeypatch.setattr(scans, "_among", lambda hashes, word: True)
    assert sorted(map(tuple, Repair(*_inputs(spark)).found().collect())) == want
