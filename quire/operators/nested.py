"""Deeply nested JSON records as related flat tables (structural variants).

Every node of a record is classified by a bottom-up tree automaton, before any row
is made.  Its alphabet is the JSON kind of a node (object, array, null, scalar); a
level's value moves it to a list of object nodes with their positions:

=============  =====================================================
value          objects (position)
=============  =====================================================
missing, null  none
array          its object elements; null and scalar elements keep
               their place in the count and give no object
bare object    itself, position 0
scalar         none
=============  =====================================================

and the state of an object follows from the states below it: ``leaf`` when its child
level moved to no object, else ``branch``.  One explode of the classified tree routes
every object to the table of its level, the supertype, which holds the keys and
parent links that all variants share; each (level, state, optional fields present)
is a structural variant with a typed subtype table.  Members that no level declares
are kept (``others``, their JSON by name).

A record whose text is null, empty or cut off (not one whole JSON value) gives
no rows.  Repeated rows of a record give each object once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """One nesting level: the member that holds it, the field that names an
    object, and its optional typed fields (name, Spark type)."""

    name: str
    member: str
    label: str | None
    fields: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Shape:
    """A record shape of any number of levels. ``roots`` are the JSON paths at which the
    first level may stand, the first one present and not null is taken."""

    table: str
    parent: str
    roots: tuple[str, ...]
    levels: tuple[Level, ...]


RUNS = Shape(
    "cached_runs",
    "run_id",
    ("$.modules", "$.report.modules"),
    (
        Level("modules", "modules", "name", (("weight", "double"),)),
        Level("checks", "checks", "id", (("severity", "string"), ("n", "bigint"))),
        Level("evidence", "evidence", None, (("page", "int"), ("detail", "string"), ("box", "array<double>"))),
    ),
)
VERDICTS = Shape(
    "verdicts",
    "verdict_id",
    ("$",),
    (
        Level("discrepancies", "discrepancies", "field", (("detail", "string"),)),
        Level("records", "records", "source", (("doi", "string"),)),
        Level("dates", "dates", "kind", (("year", "int"),)),
    ),
)


def _members(v: Column) -> Column:
    """The members of an object; null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _object_list(value: Column) -> Column:
    """The automaton's list step: array<struct<pos, v>> of the object nodes of a level's value."""
    items = F.try_variant_get(value, "$", "array<variant>")
    placed = F.transform(items, lambda e, i: F.struct(i.cast("int").alias("pos"), e.alias("v")))
    bare = F.array(F.struct(F.lit(0).alias("pos"), value.alias("v")))
    return F.when(items.isNotNull(), F.filter(placed, lambda x: _members(x["v"]).isNotNull())).when(_members(value).isNotNull(), bare)


def _text(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "string")


def _classified(value: Column, shape: Shape, k: int, above: Column | None, labels: Column | None) -> Column:
    """The objects of level ``k`` in ``value`` and all below, states from the bottom up, as one list of
    struct(level, pos, labels, v, state): pos and labels are those of the path."""
    level = shape.levels[k]

    def node(x: Column) -> Column:
        label = _text(x["v"], level.label) if level.label else F.lit(None).cast("string")
        pos = F.array(x["pos"]) if above is None else F.concat(above, F.array(x["pos"]))
        path = F.array(label) if labels is None else F.concat(labels, F.array(label))

        def own(state: Column) -> Column:
            return F.struct(F.lit(k + 1).alias("level"), pos.alias("pos"), path.alias("labels"), x["v"].alias("v"), state.alias("state"))

        if k + 1 == len(shape.levels):
            return F.array(own(F.lit("leaf")))
        member = F.try_variant_get(x["v"], f"$.{shape.levels[k + 1].member}", "variant")
        below = _classified(member, shape, k + 1, pos, path)
        # a list of one binds what is below to a name, so that it is worked out once
        bound = F.transform(F.array(below), lambda b: F.when(F.size(b) > 0, F.concat(F.array(own(F.lit("branch"))), b)).otherwise(F.array(own(F.lit("leaf")))))
        return bound[0]

    return F.flatten(F.transform(_object_list(value), node))


def parsed(df: DataFrame, shape: Shape, text: str) -> DataFrame:
    """(parent, j): the whole JSON values of the distinct records."""
    base = df.select(F.col(shape.parent).alias("parent"), F.col(text).alias("__text")).distinct()
    return base.select("parent", F.try_parse_json("__text").alias("j")).filter(F.col("j").isNotNull())


def objects(df: DataFrame, shape: Shape, text: str) -> DataFrame:
    """(parent, level, pos, labels, v, state), one row per object of any level: the supertype of all."""
    at = [F.expr(f"try_variant_get(j, '{p}', 'variant')") for p in shape.roots]
    root = F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in at])
    rooted = parsed(df, shape, text).select("parent", root.alias("root"))
    return rooted.select("parent", F.explode(_classified(F.col("root"), shape, 0, None, None)).alias("o")).select("parent", "o.*")


def leaf_rows(df: DataFrame, shape: Shape, text: str, leaf: str = "deepest") -> DataFrame:
    """(tbl, parent, pos_1, pos_2, pos_3, leaf), one row per object in the state ``leaf``: without
    objects below it.  ``leaf``: ``deepest`` names a path by its second level
    where there is one, else its first; ``first`` always by its first."""
    o = objects(df, shape, text).filter("state = 'leaf'")
    pos = [F.coalesce(F.get("pos", F.lit(k)), F.lit(-1)).alias(f"pos_{k + 1}") for k in range(3)]
    first, second = F.get("labels", F.lit(0)), F.get("labels", F.lit(1))
    name = first if leaf == "first" else F.when(F.col("level") >= 2, second).otherwise(first)
    return o.select(F.lit(shape.table).alias("tbl"), "parent", *pos, name.alias("leaf")).distinct()


def level_table(df: DataFrame, shape: Shape, text: str, level: int) -> DataFrame:
    """The flat supertype table of a level (from 1): key, parent link, label, all
    optional fields (null where a variant lacks them), ``state``, ``variant``, and
    ``others``, the JSON of undeclared members by name.

    ``key`` is parent/pos_1[/pos_2[/...]], ``parent_key`` the key one level up."""
    o = objects(df, shape, text).filter(F.col("level") == level)
    spec = shape.levels[level - 1]
    declared = [f for f, _ in spec.fields] + ([spec.label] if spec.label else []) + ([shape.levels[level].member] if level < len(shape.levels) else [])
    path = F.concat(F.array(F.col("parent").cast("string")), F.transform("pos", lambda x: x.cast("string")))
    get = lambda f, t: F.try_variant_get("v", f"$.{f}", t)
    label = [_text(F.col("v"), spec.label).alias(spec.label)] if spec.label else []
    present = F.concat_ws("+", *[F.when(get(f, t).isNotNull(), F.lit(f)) for f, t in spec.fields])
    others = F.transform_values(F.map_filter(_members(F.col("v")), lambda k, _: ~k.isin(*declared)), lambda _, v: F.to_json(v))
    out = o.select(
        "parent",
        F.array_join(path, "/").alias("key"),
        F.array_join(F.slice(path, 1, level), "/").alias("parent_key"),
        *[F.get("pos", F.lit(k)).alias(f"pos_{k + 1}") for k in range(level)],
        *label,
        *[get(f, t).alias(f) for f, t in spec.fields],
        "state",
        F.concat_ws(":", F.lit(spec.name), "state", F.when(present != "", present)).alias("variant"),
        others.alias("others"),
    )
    return out.dropDuplicates(["key"])


def record_table(df: DataFrame, shape: Shape, text: str) -> DataFrame:
    """(parent, root, others): each record that is an object, the path at which its first level stands, and the
    names of its members beside that, in order."""
    at = [(p, F.expr(f"try_variant_get(j, '{p}', 'variant')")) for p in shape.roots]
    root = F.coalesce(*[F.when(v.isNotNull() & ~F.is_variant_null(v), F.lit(p)) for p, v in at])
    tops = {p.removeprefix("$").lstrip(".").partition(".")[0] for p in shape.roots}
    members = _members(F.col("j"))
    names = F.filter(F.array_sort(F.map_keys(members)), lambda k: ~k.isin(*tops))
    return parsed(df, shape, text).filter(members.isNotNull()).select("parent", root.alias("root"), F.array_join(names, ",").alias("others")).distinct()


def subtype(table: DataFrame, variant: str) -> DataFrame:
    """The typed subtype table of one variant: the shared keys plus only the
    fields that the variant has."""
    has = set(variant.split(":")[2].split("+")) if variant.count(":") == 2 else set()
    shared = {"parent", "key", "parent_key", "name", "id", "field", "source", "kind", "others"}
    return table.filter(F.col("variant") == variant).select(*[c for c in table.columns if c in shared or c.startswith("pos_") or c in has])


def variants(df: DataFrame, shape: Shape, text: str) -> DataFrame:
    """(tbl, variant, n): how many objects each structural variant has."""
    tables = [level_table(df, shape, text, k + 1).select("variant") for k in range(len(shape.levels))]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(F.lit(shape.table).alias("tbl"), "variant").agg(F.count("*").alias("n"))
