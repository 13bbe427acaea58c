"""Queries of problem 3 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators.nested import RUNS, VERDICTS, Shape, leaf_rows, level_table, record_table, subtype, variants
from quire.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object without objects below it, of both JSON columns."""
    runs = leaf_rows(table(spark, sf_dir, "cached_runs"), RUNS, "counts")
    return runs.unionByName(leaf_rows(table(spark, sf_dir, "verdicts"), VERDICTS, "discrepancies", "first"))


def _level(shape: Shape, text: str, level: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = level_table(table(spark, sf_dir, shape.table), shape, text, level)
        return out.drop("box", "others")

    return query


def p3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects each structural variant has."""
    runs = variants(table(spark, sf_dir, "cached_runs"), RUNS, "counts")
    return runs.unionByName(variants(table(spark, sf_dir, "verdicts"), VERDICTS, "discrepancies"))


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached runs themselves: where their modules stand, and which members stand beside."""
    return record_table(table(spark, sf_dir, "cached_runs"), RUNS, "counts")


def p3_severe_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtype table of checks with a severity, a number and evidence below."""
    checks = level_table(table(spark, sf_dir, "cached_runs"), RUNS, "counts", 2)
    return subtype(checks, "checks:branch:severity+n").drop("others")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_variants": p3_variants, "p3_runs": p3_runs, "p3_severe_checks": p3_severe_checks} | {
    f"p3_{shape.levels[k - 1].name}": _level(shape, text, k)
    for shape, text in ((RUNS, "counts"), (VERDICTS, "discrepancies"))
    for k in (1, 2, 3)
}


def _objects(value: str) -> str:
    """Rows (p, v) of the objects of a JSON value in DuckDB."""
    return (
        f"(SELECT CAST(i - 1 AS INTEGER) AS p, json_extract({value}, '$[' || CAST(i - 1 AS VARCHAR) || ']') AS v "
        f"FROM generate_series(1, CAST(CASE WHEN json_type({value}) = 'ARRAY' THEN json_array_length({value}) ELSE 0 END AS BIGINT)) g(i) "
        f"WHERE json_type(json_extract({value}, '$[' || CAST(i - 1 AS VARCHAR) || ']')) = 'OBJECT' "
        f"UNION ALL SELECT 0, {value} WHERE json_type({value}) = 'OBJECT')"
    )


def _paths(shape: Shape, text: str) -> str:
    at = ", ".join(f"CASE WHEN json_type(j, '{r}') <> 'NULL' THEN json_extract(j, '{r}') END" for r in shape.roots)
    b, c = shape.levels[1].member, shape.levels[2].member
    return f"""
WITH t AS (SELECT DISTINCT {shape.parent} AS parent, CASE WHEN json_valid({text}) THEN CAST({text} AS JSON) END AS j FROM {shape.table}),
r AS (SELECT parent, coalesce({at}) AS v0 FROM t WHERE j IS NOT NULL),
l1 AS (SELECT parent, o.p AS pos_1, o.v AS v1, json_extract(o.v, '$.{b}') AS w1 FROM r, LATERAL {_objects("v0")} o),
l2 AS (SELECT l1.parent, pos_1, v1, coalesce(o.p, -1) AS pos_2, o.v AS v2, json_extract(o.v, '$.{c}') AS w2 FROM l1 LEFT JOIN LATERAL {_objects("w1")} o ON true),
l3 AS (SELECT l2.parent, pos_1, v1, pos_2, v2, coalesce(o.p, -1) AS pos_3, o.v AS v3 FROM l2 LEFT JOIN LATERAL {_objects("w2")} o ON true)
"""


def _leaf_sql(shape: Shape, text: str, leaf: str) -> str:
    first, second = f"v1->>'$.{shape.levels[0].label}'", f"v2->>'$.{shape.levels[1].label}'"
    name = first if leaf == "first" else f"CASE WHEN pos_2 >= 0 THEN {second} ELSE {first} END"
    return f"SELECT * FROM ({_paths(shape, text)} SELECT DISTINCT '{shape.table}' AS tbl, parent, pos_1, pos_2, pos_3, {name} AS leaf FROM l3)"


_SQL_TYPES = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}


def _level_sql(shape: Shape, text: str, level: int) -> str:
    spec = shape.levels[level - 1]
    path = ["parent", *[f"CAST(pos_{k} AS VARCHAR)" for k in range(1, level + 1)]]
    key, up = (" || '/' || ".join(p) for p in (path, path[:-1]))
    v = f"v{level}"
    cols = [f"{v}->>'$.{spec.label}' AS {spec.label}"] if spec.label else []
    cols += [f"TRY_CAST({v}->>'$.{f}' AS {_SQL_TYPES[t]}) AS {f}" for f, t in spec.fields if t in _SQL_TYPES]
    has = [f"CASE WHEN ({v}->>'$.{f}') IS NOT NULL THEN '{f}' END" for f, _ in spec.fields]
    state = "'leaf'" if level == 3 else f"CASE WHEN max(pos_{level + 1}) OVER (PARTITION BY {key}) >= 0 THEN 'branch' ELSE 'leaf' END"
    return f"""SELECT *, '{spec.name}:' || state || CASE WHEN had <> '' THEN ':' || had ELSE '' END AS variant FROM (
SELECT DISTINCT parent, {key} AS key, {up} AS parent_key, {", ".join(f"pos_{k}" for k in range(1, level + 1))}, {", ".join(cols)}, {state} AS state,
concat_ws('+', {", ".join(has)}) AS had FROM ({_paths(shape, text)} SELECT * FROM l3) WHERE pos_{level} >= 0)"""


def _without(sql: str, column: str) -> str:
    return f"SELECT * EXCLUDE ({column}) FROM ({sql})"


ORACLE: dict[str, str] = {
    "p3_found": _leaf_sql(RUNS, "counts", "deepest") + " UNION ALL " + _leaf_sql(VERDICTS, "discrepancies", "first")
} | {
    f"p3_{shape.levels[k - 1].name}": _without(_level_sql(shape, text, k), "had")
    for shape, text in ((RUNS, "counts"), (VERDICTS, "discrepancies"))
    for k in (1, 2, 3)
}

_SHAPES = ((RUNS, "counts"), (VERDICTS, "discrepancies"))
ORACLE["p3_variants"] = " UNION ALL ".join(
    f"SELECT '{shape.table}' AS tbl, variant, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT variant FROM ({_level_sql(shape, text, k)})' for k in (1, 2, 3))}) GROUP BY ALL" for shape, text in _SHAPES
)
ORACLE["p3_runs"] = (
    "SELECT DISTINCT parent, CASE WHEN coalesce(json_type(a), 'NULL') <> 'NULL' THEN '$.modules' WHEN coalesce(json_type(b), 'NULL') <> 'NULL' THEN '$.report.modules' END AS root, "
    "array_to_string(list_sort(list_filter(json_keys(j), lambda k: k NOT IN ('modules', 'report'))), ',') AS others "
    "FROM (SELECT parent, j, json_extract(j, '$.modules') AS a, json_extract(j, '$.report.modules') AS b "
    "FROM (SELECT run_id AS parent, CAST(counts AS JSON) AS j FROM cached_runs WHERE json_valid(counts))) WHERE json_type(j) = 'OBJECT'"
)
ORACLE["p3_severe_checks"] = f"SELECT parent, key, parent_key, pos_1, pos_2, id, severity, n FROM ({_level_sql(RUNS, 'counts', 2)}) WHERE variant = 'checks:branch:severity+n'"
