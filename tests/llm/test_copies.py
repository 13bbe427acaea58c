"""Copies against brute force over all pairs."""

import itertools
import random

from pyspark.sql import functions as F

from quire.llm.copies import Trie, buckets, canonical_publication, canonical_rows, canonical_text, collapsed, pairs, same_words

RAW = [
    ("b1", "[7] Jane Doe. 2012. A Large-scale Study of Data-to-text. In Conf. X. pages 1-2."),
    ("b2", "JANE DOE (2012) a large scale study of data-\nto-text; In Conf X; pages 1-2"),
    ("b3", "A Large-scale Study of Datatotext. Jane Doe. 2012. In Conf. X. pages 1-2."),
    ("b4", "Jane Deo. 2012. A Large-scale Study of Data-to-text. In Conf. X. pages 1-2."),
    ("b5", "Jane Doe. 2012. A Large-scale Study of Data-to-text. In Conf. X. pages 1-2. Header 12"),
    ("b6", "Jane Doé. 2012. A Large-scale Study of Data-to-text. In Conf. X. pages 1-2."),
    ("b1", "[7] Jane Doe. 2012. A Large-scale Study of Data-to-text. In Conf. X. pages 1-2."),
    ("b7", None), ("b8", ""), ("b9", " - "), (None, "Jane Doe"), ("c1", "x " * 20_000), ("c2", "X" * 20_000),
]


def brute(rows):
    """Star pairs by comparing every two rows."""
    keys = sorted({(k, canonical_text(r)) for k, r in rows if k and canonical_text(r)[0]})
    first = {}
    for (a, (ca, fa)), (b, (cb, fb)) in itertools.combinations(keys, 2):
        if a != b and ca == cb and same_words(fa, fb):
            first[b] = min(first.get(b, a), a)
    return {(a, b) for b, a in first.items()}


def _df(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "entry_id string, raw string, form string")


def test_pairs_equal_brute_force(spark):
    rows = canonical_rows(_df(spark, RAW), "bib_entries", "entry_id", ["raw"], canonical_text)
    got = {(r.key_a, r.key_b) for r in pairs(rows, limit=2).collect()}
    assert got == brute(RAW) == {("b1", "b2"), ("b1", "b3"), ("c1", "c2")}
    n = {r.key: r.n_copies for r in collapsed(rows).collect()}
    assert n["b1"] == 3 and n["b4"] == 1 and "b7" not in n


def test_hot_group_and_empty(spark):
    rows = [(f"k{i:04d}", "The same text." if i % 3 == 0 else f"text {i}") for i in range(900)]
    found = pairs(canonical_rows(_df(spark, rows), "bib_entries", "entry_id", ["raw"], canonical_text), limit=20).collect()
    assert len(found) == 299 and {r.key_a for r in found} == {"k0000"}
    assert pairs(canonical_rows(_df(spark, rows).limit(0), "bib_entries", "entry_id", ["raw"], canonical_text)).count() == 0


def test_publication_fields():
    a = canonical_publication("A: Title", '["Doe, Jane", "B. C"]', "2001", "V", None, "10.1/X", None)
    same = canonical_publication("a title", '["Jane Doe","B C"]', "2001", "v.", None, "10.1/x", None)
    assert a[0] == same[0] and same_words(a[1], same[1])
    assert a[0] != canonical_publication("a title", '["Jane Doe"]', "2001", "v", None, "10.1/x", None)[0]
    assert a[0] != canonical_publication("a title", '["Jane Doe", "B. C"]', "2001", "v", "1", "10.1/x", None)[0]
    assert canonical_publication(None, None, None, None, None, None, None) == ("", "")
    assert canonical_publication("t", "not json", None, None, None, None, None)[0]


def test_trie_counts():
    random.seed(3)
    words = ["".join(random.choice("ab") for _ in range(random.randint(1, 6))) for _ in range(500)]
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, "", f"{i:03d}", 1)
    got = {k: c[""] for k, c in trie.terminals()}
    assert got == {w: (f"{words.index(w):03d}", words.count(w)) for w in set(words)}


def test_buckets_fit(spark):
    rows = spark.range(2000).selectExpr("'t' AS tbl", "cast(id AS string) AS key", "concat('same', md5(cast(id AS string))) AS canon")
    whole, split = buckets(rows, 50, 1)
    n = [r["count"] for r in whole.groupBy("bucket").count().collect()]
    assert sum(n) == 2000 and max(n) <= 50 and split is None
    # equal bytes are split by keys
    hot = rows.withColumn("canon", F.when(F.col("key").cast("int") % 2 == 0, F.lit("hot")).otherwise(F.col("canon")))
    whole, split = buckets(hot, 300, 2, 8)
    n = [r["count"] for r in split.groupBy("bucket").count().collect()]
    assert whole.count() + sum(n) == 2000 and len(n) >= 4


def test_counts_of_split_buckets(spark):
    """A hot set above the limit, in two word forms, gives the same counts as in one bucket."""
    rows = [(f"k{i:04d}", ("Jane Doe. A Title.", "A title. Doe, Jane", f"Other {i}")[i % 3]) for i in range(900)] + [("k0000", "Jane Doe. A Title.")]
    df = canonical_rows(_df(spark, rows), "bib_entries", "entry_id", ["raw"], canonical_text)
    want = {tuple(r) for r in collapsed(df).collect()}
    assert {tuple(r) for r in collapsed(df, limit=50).collect()} == want and ("bib_entries", "k0000", 600) in want
    assert {tuple(r) for r in pairs(df, limit=50).collect()} == {tuple(r) for r in pairs(df).collect()}


def test_names_joined_or_split():
    a = canonical_publication("t", '["Nathaniel Drot-Hudansen", "O\'Brien, J.B."]', None, None, None, None, None)
    b = canonical_publication("T", '["Drot Hudansen, Nathaniel", "JB OBrien"]', None, None, None, None, None)
    c = canonical_publication("T", '["Drot Hudnasen, Nathaniel", "JB OBrien"]', None, None, None, None, None)
    assert a[0] == b[0] == c[0] and same_words(a[1], b[1]) and not same_words(a[1], c[1])
