"""Mixes: shares, caps, order, dirty rows."""

import random
from collections import Counter

from quire.llm.mixing import mixed, reached


def _documents(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(50, 900), "big" if i % 3 else "small", "t") for i in range(400)]
    rows += [(900, None, "big", "t"), (901, "", "small", "t"), (902, "text", None, "t"), (None, "text", "big", "t"), (1, rows[1][1], "big", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix string")


def _targets(spark):
    rows = [("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "none", 0.1, 2), ("one", "small", 1.0, 2), ("zero", "none", 1.0, 1), (None, "big", 1.0, 1)]
    return spark.createDataFrame(rows, "mix string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = _documents(spark), _targets(spark)
    rows = mixed(docs, targets).collect()
    uses = Counter((r.mix, r.doc_id) for r in rows)
    assert max(n for (m, d), n in uses.items() if m == "m" and d % 3) == 1 and max(n for (m, _), n in uses.items() if m == "one") == 2
    assert len({(r.mix, r.doc_id, r.copy) for r in rows}) == len(rows)
    got = {(r.mix, r.source): r for r in reached(docs, targets).collect()}
    assert abs(got["m", "big"].reached_share - 5 / 9) < 0.02 and got["m", "none"].n_rows == 0 and got["zero", "none"].reached_share == 0
    # early stretches are mixed too
    first = [r for r in rows if r.mix == "m" and r.slot < max(x.slot for x in rows if x.mix == "m") // 4]
    big = sum(r.n_tokens for r in first if r.source == "big") / sum(r.n_tokens for r in first)
    assert abs(big - 5 / 9) < 0.06
    again = mixed(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty(spark):
    assert mixed(_documents(spark).limit(0), _targets(spark)).count() == 0
    assert mixed(_documents(spark), _targets(spark).limit(0)).count() == 0
