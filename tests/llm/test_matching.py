"""Matching against all pairs by the same comparison, and on dirty rows."""

import itertools
import random

import pandas as pd
import pytest

from quire.llm import matching
from quire.llm.matching import ACCEPT, _hashes, assigned, author_tokens, candidates, compare, entry_features, keys_of, match, neighbours, record_features, venue_form, venues_agree

E = "entry_id string, raw string, title string, authors array<string>, year int, venue string, pages string, doi string, k1 string"
R = "record_id string, title string, authors array<string>, year int, years array<int>, venue string, pages string, doi string, preprint boolean, journal_ref string, published_doi string, work string"


def _entries(spark):
    return spark.createDataFrame(
        [
            ("e1", "Doe, J. A Study of Lexical Parsing in Velturi. 2012. In TORCM. pages 3-9.", "A Study of Lexical Parsing in Velturi", ["Doe, J."], 2012, "TORCM", "3-9", None, "x"),
            ("e2", "Jane Doe. 2012. A Study of Lexical Parsing in Velturi. Conf. Multiling. Meth. Torta.", None, None, None, None, None, None, "x"),
            ("e3", "Jane Doe. A Study of Lexical Parsing in Velturi: A Replication. 2014. WZAHO 2014.", "A Study of Lexical Parsing in Velturi: A Replication", ["Jane Doe"], 2014, "WZAHO 2014", None, None, "x"),
            ("e4", "Bo Li. A Study of Lexical Parsing in Velturi. 2012. JUGIA.", "A Study of Lexical Parsing in Velturi", ["Bo Li"], 2012, "JUGIA", None, None, "x"),
            ("e5", None, None, None, None, None, None, None, "x"),
            ("e5", None, None, None, None, None, None, None, "x"),
            (None, "x", "A Study of Lexical Parsing in Velturi", ["Doe, J."], 2012, "TORCM", "3-9", None, "x"),
            ("e6", "", "A Stduy of Lexical Parsing in Velturi", ["J. Doe", "et al."], 2013, "Conference on Multilingual Methods of Torta", "3-9", None, "x"),
        ],
        E,
    )


def _records(spark):
    return spark.createDataFrame(
        [
            ("r1", "A Study of Lexical Parsing in Velturi", ["Jane Doe"], 2012, [], "Proceedings of the Conference on Multilingual Methods of Torta", "3--9", "10.9/w.1", False, None, None, "w"),
            ("r2", "A study of lexicаl parsing in velturi", ["Doe J"], 2011, None, "prepserv preprint", None, None, True, None, "10.9/w.1", "w"),
            ("r3", None, None, None, None, None, None, None, None, None, None, "w"),
            (None, "A Study of Lexical Parsing in Velturi", ["Jane Doe"], 2012, [], "TORCM", "3-9", None, False, None, None, "w"),
        ],
        R,
    )


def test_match(spark):
    got = {(r.entry_id, r.record_id) for r in match(_entries(spark), _records(spark)).collect()}
    assert got == {("e1", "r1"), ("e1", "r2"), ("e2", "r1"), ("e2", "r2"), ("e6", "r1"), ("e6", "r2")}
    assert match(_entries(spark).limit(0), _records(spark)).count() == 0
    assert match(_entries(spark), _records(spark).limit(0)).count() == 0


def _with_ids(df, odd):
    rows = [(2 * i + odd, x.traits, _hashes(x.traits), x.id) for i, x in enumerate(df.collect())]
    return df.sparkSession.createDataFrame(rows, "id long, traits string, hs array<long>, name string")


def test_candidates_hold_every_match_of_all_pairs(spark, monkeypatch):
    e, r = _with_ids(entry_features(_entries(spark)), 1), _with_ids(record_features(_records(spark)), 0)
    want = {(a.id, b.id) for a in e.collect() for b in r.collect() if compare(a.traits, b.traits) >= ACCEPT}
    assert want and want <= {tuple(x) for x in candidates(e, r).collect()}
    # every key value is crowded: the finer order brings them together
    monkeypatch.setattr(matching, "BLOCK", 0)
    assert want <= {tuple(x) for x in candidates(e, r).collect()}


def test_window_slides_over_distinct_values(spark):
    rows = [("aaaa", True)] * 500 + [("aaab", True), ("aabb", True), ("zzzz", True), ("aabc", False)]
    got = {tuple(x) for x in neighbours(spark.createDataFrame(rows, "k string, r boolean"), 2, 1).collect()}
    assert got == {("aaaa", "aaab"), ("aaab", "aaaa"), ("aaab", "aabb"), ("aabb", "aaab"), ("aabc", "aabb")}


def test_window_across_short_ranges(spark):
    """Ranges of fewer values than the window hide no pair of their two sides."""
    words = [f"aaaa{c}" for c in "abcdefgh"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(sorted(x)) for x in neighbours(spark.createDataFrame([(w, True) for w in words], "k string, r boolean"), 4, 1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 : i + 5]}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("TORCM 2016", "Conf. Multiling. Meth. Torta", True),
        ("WZAHO", "Proceedings of the Workshop on Speech Systems and Zaho", True),
        ("Ugi J. Appl. Infer.", "JUGIA", True),
        ("Ugi J. Appl. Infer.", "Ugi Journal of Applied Inference", True),
        ("TORCM", "WZAHO", False),
        ("ACL 2020", "Proceedings of the 58th Annual Meeting of the Association for Computational Linguistics", True),
        ("Proc. of EMNLP", "Conference on Empirical Methods in Natural Language Processing", True),
        ("NeurIPS", "Advances in Neural Information Processing Systems", True),
        ("VLDB", "Proceedings of the International Conference on Very Large Data Bases", True),
        ("NeurIPS", "Proceedings of the Annual Meeting of the Association for Computational Linguistics", False),
        ("Conference on Language Engineering of Brebo", "Conference on Language Engineering of Broba", False),
        ("Workshop on Language Engineering of Brebo", "Conference on Language Engineering of Brebo", False),
    ],
)
def test_venues(a, b, same):
    assert venues_agree(venue_form(a), venue_form(b)) is same


def test_venue_of_nothing():
    assert venue_form(None) == venue_form("") == venue_form("Proceedings") == ""


def test_hashes_are_the_engines(spark):
    text = entry_features(_entries(spark)).filter("id = 'e1'").first().traits
    want = spark.createDataFrame([(k,) for k in keys_of(text)], "k string").selectExpr("xxhash64(k) h").collect()
    assert _hashes(text) == [x.h for x in want]


def test_one_to_one():
    """Two entries of a document want work 1; the total is greatest if the one that has another goes there."""
    options = pd.DataFrame([("a", 1, 0.9), ("a", 2, 0.85), ("b", 1, 0.8), ("c", 7, 0.7), ("d", 7, 0.75)], columns=["entry_id", "work", "confidence"])
    got = {r.entry_id: r.work for r in assigned(options).itertuples()}
    assert got == {"a": 2, "b": 1, "c": 7, "d": 7}


def test_one_to_one_against_every_assignment():
    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        conf = {(e, w): round(rng.uniform(0.6, 1.0), 2) for e in range(n) for w in range(m) if rng.random() < 0.6}
        rows = [(str(e), w, c) for (e, w), c in conf.items()]
        if not rows:
            continue
        ways = itertools.product(*[[None, *[w for w in range(m) if (e, w) in conf]] for e in range(n)])
        best = max(sum(conf[e, w] for e, w in enumerate(way) if w is not None) for way in ways if len(u := [w for w in way if w is not None]) == len(set(u)))
        got = assigned(pd.DataFrame(rows, columns=["entry_id", "work", "confidence"]))
        assert got.groupby("work")["confidence"].max().sum() >= best - 0.01


def test_pages_and_doi():
    a = "astudyofparsing\tdoe\t2012\t\t3-9\t\t\tdoe"
    assert compare(a, a.replace("3-9", "3-8")) >= ACCEPT  # one number mistyped
    assert compare(a, a.replace("3-9", "103-108")) == 0.0
    one = a.replace("\t\tdoe", "\t10.9/x\tdoe")
    assert compare(one, one.replace("3-9", "103-108")) >= ACCEPT


def test_author_tokens():
    assert author_tokens(["Doe, J.", "et al.", None, "Łukasz Brím*", "and others"]) == ["doe", "lukasz", "brim"]


def test_very_long_fields(spark):
    title = "A Study of " + "very long titles and " * 5_000
    e = spark.createDataFrame([("e1", title + ". Jane Doe. 2012.", title, ["Jane Doe"] * 2_000, 2012, "TORCM", "3-9", None, "x")], E)
    r = spark.createDataFrame([("r1", title, ["Jane Doe"], 2012, [], "TORCM", "3-9", None, False, None, None, "w")], R)
    assert [tuple(x)[:2] for x in match(e, r).collect()] == [("e1", "r1")]


def test_all_rows_of_a_crowded_value_meet(spark):
    """Under one key value every citation meets every record, however far apart a finer order would set them."""
    n = 150
    left = spark.createDataFrame([(2 * i + 1, f"\t\t\t\t\t\t\t{i:03d}", [7]) for i in range(40)], "id long, traits string, hs array<long>")
    right = spark.createDataFrame([(2 * i, f"\t\t\t\t\t\t\t{i:03d}", [7]) for i in range(n)], "id long, traits string, hs array<long>")
    got = [tuple(x) for x in candidates(left, right).collect()]
    assert len(got) == 40 * n and set(got) == {(2 * i + 1, 2 * j) for i in range(40) for j in range(n)}
