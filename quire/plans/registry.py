"""Registry of checks and the run that turns them into one findings table.

A check is a function of (tables, profile) that gives a DataFrame with at least
doc_id, severity and message.  ``run`` selects checks by module and flags,
wraps each plan's construction so that one that fails becomes a skipped finding,
unites them, and remaps severities by the profile's overrides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.config import SEVERITIES
from quire.session import landed

FINDINGS = "doc_id long, check_id string, title string, category string, severity string, message string, measured double, page int, quote string"
#: Columns a check may leave out.
_OPTIONAL = {"measured": "double", "page": "int", "quote": "string"}


@dataclass(frozen=True)
class Check:
    id: str
    title: str
    module: str
    category: str
    order: int
    requires: frozenset[str]
    build: Callable[..., DataFrame] = field(compare=False)


class Views:
    """The tables of a run, and the views of them that several checks read: each is written once to the shared folder."""

    def __init__(self, tables: Callable[[str], DataFrame]) -> None:
        self.tables, self.made = tables, {}

    def __call__(self, name: str) -> DataFrame:
        return self.tables(name)

    def view(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = landed(make(), f"view-{name}")
        return self.made[name]


class Registry:
    """Checks by id."""

    def __init__(self) -> None:
        self.checks: dict[str, Check] = {}

    def register(self, id: str, title: str, *, module: str, category: str = "general", order: int = 100, requires: tuple[str, ...] = ()):
        def wrap(build: Callable[..., DataFrame]):
            if id in self.checks:
                raise ValueError(f"check {id} is registered twice")
            self.checks[id] = Check(id, title, module, category, order, frozenset(requires), build)
            return build

        return wrap

    def selected(self, profile: dict, flags: frozenset[str] = frozenset()) -> list[Check]:
        """The checks whose module (or a dotted prefix of it) the profile has and whose flags are set."""
        modules, off = set(profile.get("modules", [])), set(profile.get("disabled_checks", []))

        def on(c: Check) -> bool:
            parts = c.module.split(".")
            return c.id not in off and c.requires <= flags and any(".".join(parts[: k + 1]) in modules for k in range(len(parts)))

        return sorted((c for c in self.checks.values() if on(c)), key=lambda c: (c.order, c.id))

    def run(self, spark: SparkSession, tables: Callable[[str], DataFrame], profile: dict, flags: frozenset[str] = frozenset()) -> DataFrame:
        out = None
        tables = Views(tables)
        for c in self.selected(profile, flags):
            try:
                df = c.build(tables, profile)
                for name, kind in _OPTIONAL.items():
                    if name not in df.columns:
                        df = df.withColumn(name, F.lit(None).cast(kind))
                one = df.select(F.col("doc_id").cast("long"), F.lit(c.id).alias("check_id"), F.lit(c.title).alias("title"), F.lit(c.category).alias("category"), "severity", "message", F.col("measured").cast("double"), F.col("page").cast("int"), "quote")
                one.schema  # noqa: B018  resolves the plan, so that a wrong one fails here
            except Exception as e:  # noqa: BLE001  one check must not sink the run
                one = spark.createDataFrame([(None, c.id, c.title, c.category, "skipped", f"Check failed to run: {type(e).__name__}: {str(e)[:200]}", None, None, None)], FINDINGS)
            out = one if out is None else out.unionByName(one)
        if out is None:
            return spark.createDataFrame([], FINDINGS)
        return overridden(out, profile.get("severity_overrides", {}))


def overridden(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """``findings`` with severities remapped by check; pass and skipped stay."""
    if not overrides:
        return findings
    spark = findings.sparkSession
    small = spark.createDataFrame(sorted(overrides.items()), "check_id string, __to string")
    joined = findings.join(F.broadcast(small), "check_id", "left")
    return joined.withColumn("severity", F.when(F.col("severity").isin("pass", "skipped") | F.col("__to").isNull(), F.col("severity")).otherwise(F.col("__to"))).drop("__to").select(*findings.columns)


def severity_counts(findings: DataFrame) -> DataFrame:
    """(doc_id, severity, n) with a row for every severity, 0 included."""
    docs = findings.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"))
    n = findings.groupBy("doc_id", "severity").agg(F.count("*").alias("n"))
    return docs.join(n, ["doc_id", "severity"], "left").select("doc_id", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def numbered(findings: DataFrame) -> DataFrame:
    """``findings`` with ``number``: by severity rank, category, check within a document."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "category", "check_id", "message")))
