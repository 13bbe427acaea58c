"""Nested records: shapes, positions, parents, dirty texts."""

import dataclasses

from quire.operators.nested import RUNS, VERDICTS, Level, leaf_rows, level_table, objects, record_table, subtype, variants

TEXTS = [
    ("a", '{"modules": [null, {"name": "m", "checks": {"id": "c", "n": "2", "evidence": [null, {"page": 3}]}}, {"name": "q"}]}'),
    ("b", '{"report": {"modules": {"name": "m2", "checks": [3, {"id": "d", "evidence": []}]}}}'),
    ("c", None),
    ("d", ""),
    ("e", '{"modules": [{"name": "cut'),
    ("f", '{"modules": null}'),
    ("f", '{"modules": null}'),
    ("g", '{"modules": null, "report": {"modules": [{"name": "late"}]}}'),
    ("h", '"text"'),
]


def _df(spark, rows=TEXTS, name="run_id", text="counts"):
    return spark.createDataFrame([(*r, 1) for r in rows], f"{name} string, {text} string, pos_1 int")


def test_leaves(spark):
    got = sorted(tuple(r)[1:] for r in leaf_rows(_df(spark), RUNS, "counts").collect())
    assert got == [("a", 1, 0, 1, "c"), ("a", 2, -1, -1, "q"), ("b", 0, 1, -1, "d"), ("g", 0, -1, -1, "late")]


def test_verdict_leaves_are_fields(spark):
    rows = [("v", '{"field": "doi", "records": [{"source": "s", "dates": {"kind": "print"}}]}'), ("w", "[]"), ("x", "[null]")]
    got = [tuple(r)[1:] for r in leaf_rows(_df(spark, rows, "verdict_id", "discrepancies"), VERDICTS, "discrepancies", "first").collect()]
    assert got == [("v", 0, 0, 0, "doi")]


def test_levels_link_to_parents(spark):
    df = _df(spark)
    checks = {r.key: r for r in level_table(df, RUNS, "counts", 2).collect()}
    modules = {r.key for r in level_table(df, RUNS, "counts", 1).collect()}
    assert checks["a/1/0"].n == 2 and checks["a/1/0"].state == "branch" and checks["b/0/1"].state == "leaf"
    assert {r.parent_key for r in checks.values()} <= modules
    leaf = subtype(level_table(df, RUNS, "counts", 2), "checks:leaf")
    assert "n" not in leaf.columns and leaf.count() == 1


def test_empty(spark):
    assert leaf_rows(_df(spark).limit(0), RUNS, "counts").count() == 0


def test_undeclared_members_are_kept(spark):
    rows = [("a", '{"totals": {"n": 2}, "schema": 3, "modules": [{"name": "m", "tags": ["x"], "weight": 1.5}]}')]
    table = level_table(_df(spark, rows), RUNS, "counts", 1).first()
    assert table.others == {"tags": '["x"]'} and table.weight == 1.5 and table.variant == "modules:leaf:weight"
    assert [tuple(r) for r in record_table(_df(spark, rows), RUNS, "counts").collect()] == [("a", "$.modules", "schema,totals")]
    assert [tuple(r) for r in variants(_df(spark, rows), RUNS, "counts").collect()] == [("cached_runs", "modules:leaf:weight", 1)]


def test_any_depth(spark):
    """A fourth level below the evidence, and a shape of one level."""
    deep = dataclasses.replace(RUNS, levels=(*RUNS.levels, Level("boxes", "boxes", "k")))
    rows = [("a", '{"modules": {"name": "m", "checks": {"id": "c", "evidence": [{"boxes": [null, {"k": "z"}]}, {"page": 1}]}}}')]
    got = sorted((r.level, r.pos, r.labels, r.state) for r in objects(_df(spark, rows), deep, "counts").collect())
    assert got == [
        (1, [0], ["m"], "branch"),
        (2, [0, 0], ["m", "c"], "branch"),
        (3, [0, 0, 0], ["m", "c", None], "branch"),
        (3, [0, 0, 1], ["m", "c", None], "leaf"),
        (4, [0, 0, 0, 1], ["m", "c", None, "z"], "leaf"),
    ]
    flat = dataclasses.replace(RUNS, levels=RUNS.levels[:1])
    assert [(r.pos, r.state) for r in objects(_df(spark, rows), flat, "counts").collect()] == [([0], "leaf")]
