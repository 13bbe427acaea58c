"""Checks defined by data: audits and checklist items that a model's reply decides.

Replies come as a table ``model_replies`` (doc_id, check_id, reply); a document
without a reply to a check is skipped, as is one whose reply is no JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.structure import issues
from quire.plans.registry import Registry

#: id, module, order, most issues reported.
AUDITS = [
    ("ai_prose_signals", "llm.prose", 1, 8), ("busy_reviewer", "llm.review", 2, 5), ("surface_triage", "llm.review", 3, 8), ("claims_vs_numbers", "llm.audit", 4, 8),
    ("figure_table", "llm.audit", 5, 8), ("complexity_claims", "llm.audit", 6, 6), ("formula_audit", "llm.audit", 7, 8), ("experiment_claims", "llm.audit", 8, 8),
    ("experiment_leakage", "llm.audit", 9, 8), ("experiment_statistics", "llm.audit", 10, 8), ("security_ethics", "llm.audit", 11, 6), ("systems_performance", "llm.audit", 12, 8),
    ("typos_grammar", "llm.prose", 13, 10),
]
#: code, gate: the kind of work that the item applies to.
ITEMS = [
    ("A1", "always"), ("A2", "always"), ("B1", "artifacts"), ("B2", "artifacts"), ("B3", "artifacts"), ("B4", "artifacts"), ("B5", "artifacts"), ("B6", "artifacts"), ("C1", "experiments"),
    ("C2", "experiments"), ("C3", "experiments"), ("C4", "experiments"), ("D1", "human_subjects"), ("D2", "human_subjects"), ("D3", "human_subjects"), ("D4", "human_subjects"), ("D5", "human_subjects"), ("E1", "always"),
]


def _replies(tables: Callable[[str], DataFrame], check: str) -> DataFrame:
    """(doc_id, check_id, reply) of every document, null where there is none."""
    docs = tables("docs").select("doc_id").distinct()
    own = tables("model_replies").filter(F.col("check_id") == check).groupBy("doc_id").agg(F.min("reply").alias("reply"))
    return docs.join(own, "doc_id", "left").select("doc_id", F.lit(check).alias("check_id"), "reply")


def audit(check: str, most: int):
    def build(tables: Callable[[str], DataFrame], profile: dict) -> DataFrame:
        r = _replies(tables, check)
        found = issues(r.withColumn("reply", F.coalesce("reply", F.lit(""))), most)
        rows = found.select("doc_id", F.when(F.col("severity") == "skipped", "skipped").otherwise("warning").alias("severity"), F.coalesce("text", F.lit("no usable reply")).alias("message"))
        clean = r.filter("reply IS NOT NULL").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
        return rows.unionByName(clean.select("doc_id", F.lit("pass").alias("severity"), F.lit("no issue reported").alias("message")))

    return build


def item(code: str, gate: str):
    def build(tables: Callable[[str], DataFrame], profile: dict) -> DataFrame:
        r = _replies(tables, f"rnlp_{code.lower()}").withColumn("answer", F.lower(F.try_variant_get(F.try_parse_json("reply"), "$.answer", "string")))
        scope = _replies(tables, "rnlp_scope").select("doc_id", F.try_variant_get(F.try_parse_json("reply"), f"$.{gate}", "boolean").alias("on"))
        at = r.join(scope, "doc_id", "left")
        applies = F.lit(gate == "always") | F.coalesce("on", F.lit(True))
        severity = F.when(F.col("answer").isNull(), "skipped").when(F.col("answer").isin("yes", "na", "n/a"), "pass").otherwise("warning")
        return at.filter(applies).select("doc_id", severity.alias("severity"), F.concat_ws(" ", F.lit(f"item {code}:"), F.coalesce("answer", F.lit("no reply"))).alias("message"))

    return build


def register(registry: Registry) -> None:
    """Add the data-defined checks to a registry."""
    for name, module, order, most in AUDITS:
        registry.register(f"audit_{name}", name.replace("_", " "), module=module, category="audit", order=300 + order, requires=("llm",))(audit(f"audit_{name}", most))
    for k, (code, gate) in enumerate(ITEMS):
        registry.register(f"rnlp_{code.lower()}", f"Checklist item {code}", module="arr.responsible_nlp", category="checklist", order=200 + k, requires=("llm",))(item(code, gate))
