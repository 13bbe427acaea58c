"""Layout, sequences, text views, resolution: small cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import layout as L
from quire.operators import resolve as R
from quire.operators import sequences as S
from quire.operators import text_views as V

SPAN = "doc_id long, page int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double, color int, flags int, render_mode int, opacity double"


def _span(doc=1, page=1, line=1, span=1, x0=72.0, y0=100.0, x1=200.0, y1=110.0, text="word", font="Serif", size=10.0, color=0, flags=0, mode=0, opacity=1.0):
    return (doc, page, line, span, x0, y0, x1, y1, text, font, size, color, flags, mode, opacity)


def test_line_takes_the_widest_span_and_bold_by_width(spark):
    rows = [_span(span=1, x1=100.0, text="A", size=12.0, flags=16), _span(span=2, x0=100.0, x1=300.0, text="b", size=9.0), _span(span=2, x0=100.0, x1=300.0, text="b", size=9.0)]
    (r,) = L.lines(L.delivered_once(spark.createDataFrame(rows, SPAN))).collect()
    assert (r.text, r.size, r.bold, r.x0, r.x1) == ("Ab", 9.0, False, 72.0, 300.0)


def test_nulls_and_empty(spark):
    rows = [_span(font=None, opacity=None, text="x y"), (1, 1, 2, 1, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SPAN)
    assert L.lines(df).count() == 2 and L.body_font_size(df).count() == 1 and L.dominant_font(df).count() == 0
    assert L.lines(df.limit(0)).count() == 0 and L.column_bands(L.lines(df.limit(0))).count() == 0


def test_inside_boxes_equals_brute_force(spark):
    rng = random.Random(1)
    spans = [_span(doc=rng.randint(1, 2), line=i, x0=(x := rng.uniform(-5, 500)), y0=(y := rng.uniform(0, 700)), x1=x + rng.uniform(1, 60), y1=y + 9) for i in range(200)]
    boxes = [(rng.randint(1, 2), 1, i, x := rng.uniform(0, 400), y := rng.uniform(0, 600), x + rng.uniform(20, 300), y + rng.uniform(20, 300)) for i in range(30)]
    s, b = spark.createDataFrame(spans, SPAN), spark.createDataFrame(boxes, "doc_id long, page int, box_no long, x0 double, y0 double, x1 double, y1 double")
    want = {t[2] for t in spans for o in boxes if t[0] == o[0] and t[4] >= o[3] - 2 and t[5] >= o[4] - 2 and t[6] <= o[5] + 2 and t[7] <= o[6] + 2}
    assert {r.line_no for r in L.inside_boxes(s, b).collect()} == want
    assert {r.line_no for r in L.inside_boxes(s, b, how="left_anti").collect()} == {t[2] for t in spans} - want


def test_two_columns(spark):
    rows = [_span(line=i, x0=72.0 if i % 2 else 320.0, x1=72.0 + 200 if i % 2 else 520.0, y0=100.0 + 10 * i, y1=109.0 + 10 * i) for i in range(40)]
    bands = sorted((r.band, r.x0, r.x1) for r in L.column_bands(L.lines(spark.createDataFrame(rows, SPAN))).collect())
    assert [b[1] for b in bands] == [72.0, 320.0]
    fit = L.column_fit(L.lines(spark.createDataFrame(rows, SPAN)), L.column_bands(L.lines(spark.createDataFrame(rows, SPAN)))).collect()
    assert fit[0].fit == 1.0


def test_runs_break_at_null_and_other_values(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, "a", "a", "a", "b", "b", "b"], 1)], "doc_id long, pos int, v string")
    assert sorted((r.v, r.start, r.length) for r in S.runs(df, ["doc_id"], ["pos"], "v", 3).collect()) == [("a", 4, 3), ("b", 7, 3)]


def test_gaps_and_numbering(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 5, 5)] + [(2, 1)], "doc_id long, n int")
    assert sorted(tuple(r) for r in S.number_gaps(df, ["doc_id"], "n").collect()) == [(1, 3), (1, 4)]
    h = spark.createDataFrame([(1, 1, i, n, n.count(".") + 1) for i, n in enumerate(["1", "1.1", "1.3", "3", "4.1", "1.1.1.1"])], "doc_id long, page int, line_no int, numbering string, depth int")
    got = {r.numbering: r.problem for r in S.numbering_problems(h).collect()}
    assert got == {"1.3": "gap", "3": "gap", "4.1": "no parent", "1.1.1.1": "too deep"}


def test_sentences_join_abbreviations(spark):
    text = "We follow the plan, cf. Smith et al. Great care was taken here. However this is a sentence of its own!\n\nShort one.\n\nFigure 3: a caption that is long enough to be a sentence."
    rows = V.sentences(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), ["doc_id"]).orderBy("pos").collect()
    assert [r.sentence.split()[0] for r in rows] == ["We", "However"] and rows[0].opener == "we"


def test_percentages(spark):
    df = spark.createDataFrame([(1, "We kept 5 of 10 items (50%). Then 1,000 of 4,000 rows, 30%."), (2, "3 of 0 (5%)"), (3, None)], "doc_id long, text string")
    assert [(r.part, r.whole, r.off) for r in V.percentage_claims(df, ["doc_id"]).collect()] == [(1000.0, 4000.0, 5.0)]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (C.normalised_doi, "https://doi.org/10.1/AB.c).", "10.1/ab.c"), (C.normalised_doi, "11.1/x", None), (C.normalised_url, "ht tps: //a.org/x y.", "https://a.org/xy"),
        (C.normalised_url, "https://model", None), (C.normalised_url, "www.a.org", "https://www.a.org"), (C.title_key, "The Théory of a Thing!", "theory thing"),
        (C.compact_title, "A-b Ç", "abc"), (C.surname, "Doe, Jane", "doe"), (C.surname, "Jane Q. Doe", "doe"), (C.found_arxiv, "arXiv:2005.14165v2", "2005.14165"), (C.found_year, "in 2012 and 1999a", 2012),
    ],
)
def test_scalars(spark, expr, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x == want


def test_page_ranges(spark):
    df = spark.createDataFrame([("1877-901",), ("019--35",), ("7",), ("x",), (None,)], "p string")
    first, last = C.page_range(F.col("p"))
    assert [tuple(r) for r in df.select(first, last).collect()] == [("1877", "1901"), ("19", "35"), ("7", None), (None, None), (None, None)]


def test_alignment_and_similarity():
    assert R.align(["doe", "roe", "smith"], ["smithson", "doe"]) == [1, -1, 0]
    assert R.similarity("a study of words", "a study of words") == 1.0 and R.similarity("", "x") == 0.0
    assert R.similarity("deep parsing", "deep parsing of long texts") > 0.7 > R.similarity("deep parsing", "shallow talk")


def test_judging(spark):
    rows = [("e", "r1", 2010, 2011, 0.95, 0.5), ("e", "r2", 2010, 2015, 0.99, 1.0), ("e", "r3", None, None, 0.92, None), ("e", "r4", 2010, 2010, 0.5, 1.0), ("e", "r5", 2010, 2010, 0.96, 0.1)]
    df = spark.createDataFrame(rows, "entry_id string, record_id string, e_year int, r_year int, score double, authors double")
    got = {r.record_id: r.outcome for r in R.judged(df).collect()}
    assert got == {"r1": "accept", "r2": "review", "r3": "review", "r4": "reject", "r5": "review"}
    assert R.best(R.judged(df)).first().record_id == "r1"


def test_unresolved_citations_equal_theta_anti_join(spark):
    rng = random.Random(2)
    bib = [(d, i, f"[{i}] Author{rng.randint(1, 9)}, J. {rng.randint(1990, 1995)}. A study.") for d, i in itertools.product((1, 2), range(8))]
    cites = [(rng.randint(1, 3), i, f"as Author{rng.randint(1, 9)} et al. ({rng.randint(1990, 1995)}) say") for i in range(60)]
    got = {tuple(r) for r in R.unresolved_citations(spark.createDataFrame(cites, "doc_id long, pos long, text string"), spark.createDataFrame(bib, "doc_id long, entry_no int, raw string")).select("doc_id", "name", "year").collect()}
    want = set()
    for d, _, t in cites:
        name, year = t.split()[1].lower(), t.split("(")[1][:4]
        if not any(b[0] == d and f" {name}," in b[2].lower() and year in b[2] for b in bib):
            want.add((d, name, year))
    assert got == want


def test_candidates_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["parsing", "deep", "of", "graphs", "speech", "neural", "the", "models", "long", "tagging", "data", "base", "database", "x"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))

    def typo(t):
        i = rng.randrange(len(t))
        return t[:i] + rng.choice(["", "q", t[i] + "z"]) + t[i + 1 :]

    cited = [title() for _ in range(60)]
    entries = [(f"e{i}", t, ["Doe"], 2010, None) for i, t in enumerate(cited)] + [("doi", "Вопрос", None, None, "10.1/A"), ("none", None, None, None, "10.1/A")]
    records = [(f"r{i}", typo(t) if i % 2 else t, ["Doe"], 2010, None, None) for i, t in enumerate(cited)] + [(f"s{i}", title(), None, None, None, None) for i in range(40)] + [("doi", "Другой", None, None, None, "https://doi.org/10.1/a")]
    e = spark.createDataFrame(entries, "entry_id string, title string, authors array<string>, year int, doi string")
    r = spark.createDataFrame(records, "record_id string, title string, authors array<string>, year int, doi string, published_doi string")
    got = {(x.entry_id, x.record_id) for x in R.candidate_pairs(e, r).collect()}
    a, b = (df.filter("title IS NOT NULL").select(k, F.col("title").alias(n), C.compact_title(F.col("title")).alias(f"{n}_k")) for df, k, n in ((e, "entry_id", "a"), (r, "record_id", "b")))
    near = (C.token_similarity(F.col("a"), F.col("b")) >= 0.5) | ((F.col("a_k") != "") & (F.col("b_k") != "") & (F.levenshtein("a_k", "b_k") <= 1)) | ((F.length("a_k") >= 24) & (F.substring("a_k", 1, 24) == F.substring("b_k", 1, 24)))
    want = {(x.entry_id, x.record_id) for x in a.crossJoin(b).filter(near).collect()}
    assert got == want | {("doi", "doi")}
    assert all((f"e{i}", f"r{i}") in got for i in range(60))


def test_glyph_run_fallback_takes_all_pages(spark, tmp_path):
    from quire.operators.structure_queries import QUERIES

    spans = [(1, 1, 0), (1, 3, 0), (1, 3, 0), (1, 4, 3), (2, 9, 0)]
    lines = [(1, 1), (1, 3), (1, 4), (1, 4), (1, 5), (3, 7)]
    spark.createDataFrame(spans, "doc_id long, page int, render_mode int").write.parquet(f"{tmp_path}/spans.parquet")
    spark.createDataFrame(lines, "doc_id long, page int").write.parquet(f"{tmp_path}/page_lines.parquet")
    got = {tuple(r) for r in QUERIES["glyph_run_fallback"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1), (1, 3, 2), (1, 4, 2), (1, 5, 1), (2, 9, 1), (3, 7, 1)}


def test_word_pairs_equal_brute_force(spark):
    """Titles of few, many and very many words meet by pairs of rare words; no pair of the word similarity is left out."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    title = lambda n: rng.sample(words, n)
    cited = [title(rng.choice([1, 2, 3, 4, 5, 7, 9, 23, 24, 25, 30, 40])) for _ in range(150)]
    known = [title(rng.choice([1, 2, 3, 4, 5, 7, 9, 23, 24, 25, 30, 40])) for _ in range(100)] + [w[1:] + ["new"] for w in cited[:50]]
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "i long, w array<string>")

    def score(x, y):
        c = len(set(x) & set(y))
        return 0.5 * c / len(set(x) | set(y)) + 0.5 * c / min(len(x), len(y))

    for least in (0.5, 0.72):
        got = [tuple(x) for x in R._word_pairs(frame(cited), frame(known), least).collect()]
        want = {(i, j) for i, x in enumerate(cited) for j, y in enumerate(known) if score(x, y) >= least - 1e-9}
        assert set(got) == want and len(got) == len(want)


def test_rare_word_pairs_leave_few_candidates():
    """A short title makes pairs of its rarest words, so that titles which share one word alone never meet."""
    import numpy as np

    w = np.arange(1, 9, dtype=np.uint64)[None]
    kinds = [k for k, *_ in R._word_keys(w, 0.585, True)]
    assert kinds.count(2) == 10 and kinds.count(1) == 0 and [k for k, *_ in R._word_keys(w, 0.585, False)].count(2) == 28


def test_best_candidates_are_those_of_all_candidates(spark):
    e = [("e1", "deep parsing of long texts", ["Doe"], 2010, None), ("e2", "shallow parsing of speech", ["Roe"], 2010, None), ("e3", "graphs", None, None, "10.1/a"), ("e4", "neural tagging models data", None, 2001, None)]
    r = [("r1", "deep parsing of long texts", ["Doe"], 2010, None, None), ("r2", "deep parsing of texts", ["Doe"], 2010, None, None), ("r3", "shallow speech", None, None, None, None), ("r4", "tables", None, None, "10.1/a", None), ("r5", "tagging data", ["Poe"], 2001, None, None), ("r6", "parsing speech data", ["Roe"], 2010, None, None)]
    e = spark.createDataFrame(e, "entry_id string, title string, authors array<string>, year int, doi string")
    r = spark.createDataFrame(r, "record_id string, title string, authors array<string>, year int, doi string, published_doi string")
    got = {tuple(x) for x in R.best_candidates(e, r).collect()}
    assert got == {tuple(x) for x in R.best(R.judged(R.scored_candidates(e, r))).collect()}
    assert {x[0] for x in got} == {"e1", "e2", "e3", "e4"} and ("e3", "r4") in {x[:2] for x in got}
