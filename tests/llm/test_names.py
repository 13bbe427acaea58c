"""Name variants: the trie join against brute force, readings, and whole groups."""

import itertools
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.names import Trie, distance, entities, families, is_name, listed, pairs, parse, shards, stream_groups, titled, trie_join


def _plain(a, b):
    """The whole edit table, with swaps."""
    t = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_neighbours_share_a_shard_and_the_automaton_finds_them(a, b):
    near = distance(a, b) <= 1
    assert min(distance(a, b, 3), 4) == min(_plain(a, b), 4)
    assert (b in set(Trie([b]).near(a))) == near
    if near:
        assert set(shards(a)) & set(shards(b))


def test_trie_join_equals_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(250)})
    got = {tuple(r) for r in trie_join(spark.createDataFrame([(w,) for w in words], "k string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(words, 2) if distance(a, b) <= 1}


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Jane Q. Doe", ("p", "doe", "jane", "q")), ("DOE, Jane Q.", ("p", "doe", "jane", "q")), ("JQ Doe", ("p", "doe", "j", "q")), ("Doe JQ", ("p", "doe", "j", "q")),
        ("J. Q. Doe1", ("p", "doe", "j", "q")), ("Łukasz Brím-Vavn Jr.", ("p", "brimvavn", "lukasz", "")), ("JQ, Doe", ("p", "doe", "j", "q")),
        ("The X University for Text Analysis", ("o", "x university tex ana", "", "")), ("Univ. of Text Anal., X", ("o", "x university tex ana", "", "")),
    ],
)
def test_readings(name, want):
    assert parse(name) == want


def test_marks():
    assert [is_name(x) for x in ("et al.", "and others", None, " ", "12", "Alia Etal")] == [False, False, False, False, False, True]


NAMES = [
    ["Jonathan Ravedor", "Jon Ravedor", "J. Ravedor", "Ravedor, Jonathan", "Ravedor Jonathan", "Jonathan Ravdeor", "Jonahtan Ravedor", "RAVEDOR, J."],
    ["Deborah K. Ravedor", "D. K. Ravedor", "Ravedor DK"],
    ["Mei Tolusk"], ["Jonathan Pimur"], ["Jonathan Keldin"], ["Deborah Fastin"],
    ["Zol Institute for Speech Research", "The Zol Institute of Speech Research", "Inst. for Speech Res., Zol", "Zol Institute for Speech Researhc"],
    ["Zol Laboratory for Speech Research"],
]


def test_groups(spark):
    rows = [(i, group + ["et al.", None], "n") for i, group in enumerate(NAMES)] + [(99, None, "n"), (98, [], "n"), (97, ["Jonathan Ravedor"] * 3, "n")]
    df = spark.createDataFrame(rows, "id int, authors array<string>, key string")
    names = listed(df, "authors").unionByName(listed(spark.createDataFrame([('["Mei Tolusk", "M. Tolusk"]',), ("broken",), (None,)], "authors string"), "authors"))
    got = {tuple(r) for r in pairs(names).collect()}
    groups = [[*g, "M. Tolusk"] if g == ["Mei Tolusk"] else g for g in NAMES]
    assert got == {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    assert entities(names.limit(0)).count() == 0


def test_very_long_names(spark):
    name = "Jane " + "abcdefgh" * 12_000
    df = spark.createDataFrame([([name, name[:-1] + "x", "Jane Doe"],)], "authors array<string>")
    assert {tuple(r) for r in pairs(listed(df, "authors")).collect()} == {tuple(sorted((name, name[:-1] + "x")))}


def test_chains_are_followed_to_their_end_and_short_surnames_by_given_name(spark):
    chain = ["ravedors", "xavedors", "xyvedors", "xyzedors", "xyzqdors", "xyzqwors", "xyzqwvrs"]
    rows = [("p", k, "jane", 10 - i) for i, k in enumerate(chain)] + [("p", "wang", "wei", 9), ("p", "wagn", "wei", 1), ("p", "yang", "li", 2), ("p", "wamg", "w", 1), ("o", "wan", "", 1)]
    got = {r.k: r.family for r in families(spark.createDataFrame(rows, "kind string, key string, first string, n long")).collect()}
    assert {got[f"p:{k}"] for k in chain} == {"p:ravedors"}
    assert (got["p:wagn"], got["p:yang"], got["p:wamg"], got["o:wan"]) == ("p:wang", "p:yang", "p:wamg", "o:wan")


def test_words_in_any_order(spark):
    """Three words without comma or initials: the surname is the end that others show to be one."""
    rows = [["Anna Maria Kowalski", "Kowalski Anna Maria", "Kowalski, Anna M.", "A. M. Kowalski"], ["Juan Garcia Lopez", "Garcia Lopez, Juan"]]
    df = spark.createDataFrame([(r,) for r in rows], "authors array<string>")
    got = {tuple(r) for r in pairs(listed(df, "authors")).collect()}
    assert got == {p for g in rows for p in itertools.combinations(sorted(g), 2)}


def test_usual_given_names_lead(spark):
    """A misspelled given name follows a usual one even where it stands more often."""
    usual = [["Dmitri Abadon"], ["Dmitri Bedelar"], ["Dmitri Cederon"]]
    rows = [*usual, ["Dmittri Ravedor"], ["Ravedor, Dmittri"], ["Dmitri Ravedor"]]
    got = {tuple(r) for r in pairs(listed(spark.createDataFrame([(r,) for r in rows], "authors array<string>"), "authors")).collect()}
    assert got == set(itertools.combinations(sorted(["Dmittri Ravedor", "Ravedor, Dmittri", "Dmitri Ravedor"]), 2))


def test_misspelled_given_names_are_told_by_their_share_of_the_surnames(spark):
    """In larger tables a misspelling stands beside many surnames, yet beside few of those of the right name."""
    rng = random.Random(3)
    surnames = sorted({"".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(5)).capitalize() for _ in range(60)})
    rows = [[f"{g} {s}"] for i, s in enumerate(surnames) for g in ("Susan", *["Susn"] * (i < 4), *["Susana"] * (i % 3 == 0))]
    got = {tuple(r) for r in pairs(listed(spark.createDataFrame([(r,) for r in rows], "authors array<string>"), "authors")).collect()}
    assert got == {(f"Susan {s}", f"Susn {s}") for s in surnames[:4]}


def test_initials_that_look_like_suffixes_and_short_forms_of_several_names(spark):
    rows = [["Jonathan R. Ravedor", "Ravedor JR", "JR, Ravedor", "Jonathan R. Ravedor Jr."], ["Edward Pimuran", "Ted Pimuran"], ["Theodore Keldinor", "Theo Keldinor", "Ted Keldinor"], ["Dr. Mei Tolusker", "Mei Tolusker IV"]]
    got = {tuple(r) for r in pairs(listed(spark.createDataFrame([(r,) for r in rows], "authors array<string>"), "authors")).collect()}
    assert got == {p for g in rows for p in itertools.combinations(sorted(g), 2)}


def test_misspelled_fields_of_organisations(spark):
    """A field misspelled in its first letters is the usual one; another field is another organisation."""
    owns = ["Zol", "Keldin", "Pimur", "Tolusk", "Fastin", "Ravedor", "Bedelar", "Cederon", "Abadon", "Krovitan", "Lumeska", "Wedoran"]
    rows = [*([f"{o} Institute for Text Analysis"] for o in owns), ["Inst. for Txt Anal., Keldin", "Pimur Institute of Text nalysis", "Zol Institute for Speech Analysis", "University Lab of"]]
    got = {tuple(r) for r in pairs(listed(spark.createDataFrame([(r,) for r in rows], "authors array<string>"), "authors")).collect()}
    assert got == {("Inst. for Txt Anal., Keldin", "Keldin Institute for Text Analysis"), ("Pimur Institute for Text Analysis", "Pimur Institute of Text nalysis")}


def test_titles_tell_who_an_initial_is(spark):
    rows = [("On Parsing", ["Jonathan Ravedor"]), ("On parsing!", ["J. Ravedor"]), ("Of Birds", ["Jennifer Ravedor"]), ("Of Bees", ["Julia Ravedor", "Ravedor J"]), (None, ["Ravedor, J."])]
    df = spark.createDataFrame(rows, "title string, authors array<string>")
    got = {tuple(r) for r in pairs(listed(df, "authors"), titled(df, "authors", "title")).collect()}
    assert got == {("J. Ravedor", "Jonathan Ravedor")}


def test_group_over_many_batches():
    """Runs of equal keys are put together whatever the batches."""
    frames = [pd.DataFrame({"g": [0, 0]}), pd.DataFrame({"g": [0]}), pd.DataFrame({"g": []}), pd.DataFrame({"g": [0, 1, 2]}), pd.DataFrame({"g": [2]})]
    op = stream_groups(["g"], lambda pdf: pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(pdf)]}))
    assert pd.concat(op(iter(frames))).to_numpy().tolist() == [[0, 4], [1, 1], [2, 2]]
