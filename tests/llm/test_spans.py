"""Shared stretches against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from quire.llm.spans import FingerprintIndex, fingerprints, fingerprints_of, pairs, shares, stretches


def _texts():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefé漢") for _ in range(rng.randint(2, 8))) for _ in range(n))
    common, other = words(60), words(80)
    rows = [(i, words(rng.randint(5, 120))) for i in range(30)]
    rows += [(100, words(20) + common + words(9)), (101, common + words(30)), (102, words(11) + common)]
    rows += [(110, words(5) + other[:200] + "x" + words(30)), (111, words(50) + other[:200] + "y" + words(3)), (112, "q" + other[:199] + "z" + words(30))]
    rows += [(120, "=" * 400 + words(20)), (121, words(12) + "=" * 260), (122, "- " * 180), (123, " " + "- " * 150 + words(10)), (124, "=" * 199)]
    rows += [(130, common + words(3) + common), (131, None), (132, ""), (133, "short"), (None, common), (100, rows[30][1])]
    return rows


def _longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def test_pairs_equal_brute_force(spark):
    rows = _texts()
    texts = {k: t for k, t in rows if k is not None and t and len(t) >= 200}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if _longest(texts[a], texts[b]) >= 200}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = {(r.doc_id_a, r.doc_id_b) for r in pairs(df, batches=3).collect()}
    assert got == want and (110, 111) in want and (111, 112) not in want
    found = {r.doc_id: r for r in shares(df, batches=1).collect()}
    assert found[101].shared_chars >= len(_texts()[31][1].split()) and found[131].share == 0.0 and found[110].shared_chars == 200
    parts = {(r.doc_id, r.start, r.end) for r in stretches(df, batches=1).collect()}
    assert any(d == 110 and e - s == 200 for d, s, e in parts)
    assert pairs(df.filter("doc_id < 0")).count() == 0


def test_hot_hash_in_blocks(spark):
    rng = random.Random(1)
    common = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = [(i, f"{i:05d}" * 3 + common) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(df, batches=1).count() == 600 * 599 // 2


def test_hot_copies_are_one_text(spark):
    """A third of all records are copies of one text: compared once, and each shares all of it."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot = text(500)
    rows = [(i, hot if i % 3 == 0 else text(300)) for i in range(90)] + [(100, "x" + hot[100:350] + "y"), (101, hot[:199])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in pairs(df).collect()}
    of = [*range(0, 90, 3), 100]
    assert got == set(itertools.combinations(of, 2))
    found = {r.doc_id: r for r in shares(df).collect()}
    assert all(found[i].share == 1.0 for i in of[:-1]) and found[100].shared_chars == 250 and found[101].share == 0.0


def test_runs_are_compacted(spark):
    df = spark.createDataFrame([(i, "word" + str(i) + " " + "abcdefghij" * 3 + str(i * 7919) * 60) for i in range(24)], "doc_id long, text string")
    index = FingerprintIndex(spark, fanout=3)
    for b in range(5):
        index.add(fingerprints(df.filter(f"doc_id % 5 = {b}")))
        index.compact()
    assert len(index.runs) == 3 and {k for k, _ in index.runs} == {0, 1}
    assert index.history().count() == fingerprints(df).count()
    # a later job goes on from the manifest
    again = FingerprintIndex(spark, index.path, fanout=3)
    assert sorted(again.runs) == sorted(index.runs) and again.buckets == index.buckets
    found = again.add(fingerprints(df.filter("doc_id = 3").withColumn("doc_id", F.lit(99).cast("long"))))
    assert {r.key for r in found.select("key").distinct().collect()} == {3, 99}


def test_runs_are_merge_joined_in_place(spark):
    """No row of a run is moved for a new batch."""
    df = spark.createDataFrame([(i, f"word{i} " * 90) for i in range(12)], "doc_id long, text string")
    index = FingerprintIndex(spark, buckets=3)
    index.add(fingerprints(df.filter("doc_id < 6")))
    old, new = index._read(index.runs[0][1]), index._write(0, fingerprints(df.filter("doc_id >= 6")))
    plan = new.hint("merge").join(old.select("fp").hint("merge"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_guarantee_of_a_common_hash():
    rng = random.Random(9)
    for _ in range(50):
        common = "".join(rng.choice("abc") for _ in range(200))
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in "ab")
        x, y = fingerprints_of(a + common)[0], fingerprints_of(common + b)[0]
        assert set(x.tolist()) & set(y.tolist())


def test_runs_of_a_period_meet_at_every_phase(spark):
    rng = random.Random(8)
    rows = []
    for i, period in enumerate([1, 7, 40, 51, 51, 51, 51, 60, 77, 99]):
        pattern = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(period))
        start = rng.randrange(period)
        rows += [(2 * i, (pattern * 400)[start : start + 200]), (2 * i + 1, (pattern * 400)[:300])]
    got = {tuple(r) for r in pairs(spark.createDataFrame(rows, "doc_id long, text string"), batches=1).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(10)}


def test_stretches_of_runs_are_whole(spark):
    """All of a long run that a shorter one elsewhere repeats is shared, at the phases that the other shows only."""
    rng = random.Random(7)
    rows = []
    for i, (period, m, n) in enumerate([(1, 900, 260), (3, 1200, 201), (51, 900, 210), (60, 700, 230), (99, 1500, 320), (2, 230, 205)]):
        pattern = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(period))
        at, to = rng.randrange(period), rng.randrange(period)
        rows += [(2 * i, f"{i}" * 3 + (pattern * 2000)[at : at + m] + "a" * (i % 2)), (2 * i + 1, (pattern * 2000)[to : to + n] + "b")]
    rows += [(50, "x" + rows[0][1][3:250] + "y" * 130 + "z"), (51, rows[3][1][20:150] + "w" * 400)]
    texts = dict(rows)
    grams = {k: [t[j : j + 200] for j in range(len(t) - 199)] for k, t in texts.items()}
    want = {}
    for k, own in grams.items():
        others = {g for o, gs in grams.items() if o != k for g in gs}
        want[k] = len({x for j, g in enumerate(own) if g in others for x in range(j, j + 200)})
    found = {r.doc_id: r.shared_chars for r in shares(spark.createDataFrame(rows, "doc_id long, text string"), batches=2).collect()}
    assert found == want and want[0] == 900
