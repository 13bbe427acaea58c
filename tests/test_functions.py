"""LaTeX, persons, captions, statements."""

import pytest
from pyspark.sql import functions as F

from quire.functions.latex import latex_text, text_of
from quire.functions.person import given_compatible, split_name
from quire.operators.captions import captions, statements


@pytest.mark.parametrize(
    ("source", "want"),
    [(r"M{\"u}ller and \'Etienne", "Müller and Étienne"), (r"\v{C}apek \& S{\o}n", "Čapek & Søn"), (r"a -- b --- c", "a – b — c"), (r"{\L}ukasz {\textbf{Bold}} 50\%", "Łukasz Bold 50%"), (r"\'{\i}", "í"), (None, None), ("", "")],
)
def test_latex(source, want):
    assert text_of(source) == want


def test_latex_column(spark):
    df = spark.createDataFrame([(r"\'e",), (None,)], "s string")
    assert [r[0] for r in df.select(latex_text(F.col("s"))).collect()] == ["é", None]


def test_persons():
    p = split_name("Doe, J. Q.")
    assert p.surname == "doe" and p.given == ("j", "q") and split_name("Jane Doe Jr.").given == ("jane",) and split_name("JQ Doe").given == ("j", "q")
    assert split_name("et al.") is None and split_name("and others") is None and split_name("Jane Doe 0001").surname == "doe"
    assert given_compatible(("jane",), ("j",)) and given_compatible(("mike",), ("michael", "x")) and not given_compatible(("jane",), ("john",)) and given_compatible((), ("x",))


def test_captions_stop_at_gap_and_next(spark):
    rows = [(1, 1, 1, 10.0, 20.0, "Figure 2: A plot of"), (1, 1, 2, 22.0, 32.0, "many things."), (1, 1, 3, 34.0, 44.0, "17"), (1, 1, 4, 34.0, 44.0, "and more"), (1, 1, 5, 80.0, 90.0, "Body text."), (1, 1, 6, 92.0, 99.0, "Table 1. Numbers"), (1, 1, 7, 100.0, 110.0, "Fig. 3: Next"), (2, 1, 1, 0.0, 9.0, "no caption")]
    got = {(r.kind, r.label): r.text for r in captions(spark.createDataFrame(rows, "doc_id long, page int, line_no int, y0 double, y1 double, text string")).collect()}
    assert got == {("figure", "2"): "A plot of many things. and more", ("table", "1"): "Numbers", ("figure", "3"): "Next"}


def test_statements_end_where_the_next_begins(spark):
    rows = [(1, 1, 1, "Intro"), (1, 2, 5, "7 Limitations"), (1, 2, 9, "Ethics Statement: we care"), (1, 3, 1, "Limitations"), (2, 1, 1, "None here")]
    got = [tuple(r) for r in statements(spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string"), {"limits": ["Limitations"], "ethics": ["Ethics Statement"]}).orderBy("start").collect()]
    assert got == [(1, "limits", 20005, 20009), (1, "ethics", 20009, None)]
