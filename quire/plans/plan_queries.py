"""Queries of the configuration, findings and run store, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import config, registry, store
from quire.plans.checks import CHECKS
from quire.plans.profiles import PROFILES
from quire.querybook import book
from quire.sources.tables import table

QUERIES, ORACLE, add = book()


def _run(spark: SparkSession, d: str, venue: str, *flags: str) -> DataFrame:
    return CHECKS.run(spark, lambda t: table(spark, d, t), config.validated(config.resolved(venue, PROFILES)), frozenset(flags))


@add("findings")
def findings(spark: SparkSession, d: str) -> DataFrame:
    """Every check of one profile over the corpus: the engine's output table."""
    return _run(spark, d, "arr", "refcheck")


@add("findings_by_check")
def findings_by_check(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "cvpr", "refcheck").groupBy("check_id", "severity").agg(F.count("*").alias("n"))


_REPLIES = """SELECT c_custkey AS doc_id, x.id AS check_id, CASE WHEN c_custkey % 11 = 0 THEN 'broken' WHEN starts_with(x.id, 'audit') THEN CASE WHEN c_custkey % 3 = 0 THEN '{{"issues": []}}' ELSE '{{"issues": [{{"severity": "low", "text": "a"}}, {{"severity": "high", "text": "b"}}]}}' END
WHEN x.id = 'rnlp_scope' THEN CASE WHEN c_custkey % 2 = 0 THEN '{{"artifacts": true, "experiments": false, "human_subjects": false}}' ELSE '{{"artifacts": false, "experiments": true, "human_subjects": true}}' END
ELSE concat('{{"answer": "', CASE c_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'partial' ELSE 'na' END, '"}}') END AS reply FROM customer, (SELECT unnest(['audit_typos_grammar', 'audit_figure_table', 'rnlp_scope', 'rnlp_a1', 'rnlp_b1', 'rnlp_c1', 'rnlp_d1']) AS id) x WHERE c_custkey % 5 <> 0"""


def _with_replies(spark: SparkSession, d: str) -> Callable[[str], DataFrame]:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    k = F.col("doc_id")
    ids = F.array(*[F.lit(x) for x in ("audit_typos_grammar", "audit_figure_table", "rnlp_scope", "rnlp_a1", "rnlp_b1", "rnlp_c1", "rnlp_d1")])
    audit = F.when(k % 3 == 0, '{"issues": []}').otherwise('{"issues": [{"severity": "low", "text": "a"}, {"severity": "high", "text": "b"}]}')
    scope = F.when(k % 2 == 0, '{"artifacts": true, "experiments": false, "human_subjects": false}').otherwise('{"artifacts": false, "experiments": true, "human_subjects": true}')
    answer = F.concat(F.lit('{"answer": "'), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "no").when(k % 4 == 2, "partial").otherwise("na"), F.lit('"}'))
    x = c.filter("doc_id % 5 <> 0").select("doc_id", F.explode(ids).alias("check_id"))
    r = x.withColumn("reply", F.when(k % 11 == 0, "broken").when(F.col("check_id").startswith("audit"), audit).when(F.col("check_id") == "rnlp_scope", scope).otherwise(answer))
    return lambda t: {"docs": c, "model_replies": r}[t]


@add(
    "model_checks",
    f"""WITH r AS ({_REPLIES.format()}), d AS (SELECT c_custkey AS doc_id FROM customer),
    a AS (SELECT d.doc_id, i.id AS check_id, r.reply FROM d CROSS JOIN (SELECT unnest(['audit_typos_grammar', 'audit_figure_table']) AS id) i LEFT JOIN r ON r.doc_id = d.doc_id AND r.check_id = i.id),
    q AS (SELECT d.doc_id, i.id AS check_id, i.gate, r.reply, s.reply AS scope FROM d CROSS JOIN (SELECT unnest(['rnlp_a1', 'rnlp_b1', 'rnlp_c1', 'rnlp_d1']) AS id, unnest(['always', 'artifacts', 'experiments', 'human_subjects']) AS gate) i LEFT JOIN r ON r.doc_id = d.doc_id AND r.check_id = i.id LEFT JOIN r s ON s.doc_id = d.doc_id AND s.check_id = 'rnlp_scope')
    SELECT check_id, severity, count(*) AS n FROM (SELECT check_id, CASE WHEN reply IS NULL OR reply = 'broken' THEN 'skipped' WHEN json_array_length(CAST(CASE WHEN json_valid(reply) THEN reply END AS JSON), '$.issues') = 0 THEN 'pass' ELSE 'warning' END AS severity,
    unnest(range(CASE WHEN reply IS NULL OR reply = 'broken' THEN 1 ELSE greatest(1, CAST(json_array_length(CAST(CASE WHEN json_valid(reply) THEN reply END AS JSON), '$.issues') AS BIGINT)) END)) AS k FROM a
    UNION ALL SELECT check_id, CASE WHEN reply IS NULL OR reply = 'broken' THEN 'skipped' WHEN regexp_matches(lower(reply), '"(yes|na)"') THEN 'pass' ELSE 'warning' END, 0 FROM q WHERE gate = 'always' OR scope IS NULL OR scope = 'broken' OR contains(scope, '"' || gate || '": true')) GROUP BY 1, 2""",
)
def model_checks(spark: SparkSession, d: str) -> DataFrame:
    """The data-defined checks over model replies, counted by check and severity."""
    profile = {"modules": ["arr.responsible_nlp", "llm.prose", "llm.audit"]}
    wanted = ["audit_typos_grammar", "audit_figure_table", "rnlp_a1", "rnlp_b1", "rnlp_c1", "rnlp_d1"]
    tables = _with_replies(spark, d)
    profile["disabled_checks"] = [c for c in CHECKS.checks if c not in wanted]
    return CHECKS.run(spark, tables, profile, frozenset({"llm"})).groupBy("check_id", "severity").agg(F.count("*").alias("n"))


@add("markdown_report")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return store.markdown(_run(spark, d, "aistats"))


_REPORT = r"\[(pass|skip|WARN|ERROR)\] ([a-z_]+) p\.([0-9]+):"
FOUND = rf"(SELECT doc_id, CASE regexp_extract(h, '{_REPORT}', 1) WHEN 'skip' THEN 'skipped' WHEN 'WARN' THEN 'warning' WHEN 'ERROR' THEN 'error' ELSE 'pass' END AS severity, regexp_extract(h, '{_REPORT}', 2) AS check_id, CAST(regexp_extract(h, '{_REPORT}', 3) AS INTEGER) AS page FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_REPORT}')) AS h FROM documents))"


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Findings read back from the check reports among the documents."""
    h = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_REPORT), 0)).alias("h"))
    s = F.regexp_extract("h", _REPORT, 1)
    severity = F.when(s == "skip", "skipped").when(s == "WARN", "warning").when(s == "ERROR", "error").otherwise("pass")
    return h.select("doc_id", severity.alias("severity"), F.regexp_extract("h", _REPORT, 2).alias("check_id"), F.regexp_extract("h", _REPORT, 3).cast("int").alias("page"))


@add("severity_override", f"SELECT doc_id, check_id, page, CASE WHEN severity IN ('pass', 'skipped') THEN severity WHEN starts_with(check_id, 'a') THEN 'unverifiable' ELSE severity END AS severity FROM {FOUND}")
def severity_override(spark: SparkSession, d: str) -> DataFrame:
    f = _reported(spark, d)
    over = f.select("check_id").distinct().filter(F.col("check_id").startswith("a")).withColumn("to", F.lit("unverifiable"))
    j = f.join(over, "check_id", "left")
    return j.select("doc_id", "check_id", "page", F.when(F.col("severity").isin("pass", "skipped") | F.col("to").isNull(), F.col("severity")).otherwise(F.col("to")).alias("severity"))


@add("counts_by_severity", f"SELECT d.doc_id, s.severity, count(f.severity) AS n FROM (SELECT DISTINCT doc_id FROM {FOUND}) d CROSS JOIN (SELECT unnest(['error', 'warning', 'pass', 'skipped', 'unverifiable']) AS severity) s LEFT JOIN {FOUND} f ON f.doc_id = d.doc_id AND f.severity = s.severity GROUP BY 1, 2")
def counts_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return registry.severity_counts(_reported(spark, d))


@add("findings_rollup", f"SELECT severity, left(check_id, 1) AS module, count(*) AS n FROM {FOUND} GROUP BY ROLLUP (severity, module)")
def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _reported(spark, d).rollup("severity", F.substring("check_id", 1, 1).alias("module")).agg(F.count("*").alias("n"))


_EDGES = [("arr", "acl"), ("acl", "base"), ("neurips", "base"), ("baylearn", "neurips"), ("iclr", "base")]
_LEAVES = [("base", "columns", "2"), ("base", "size", "11"), ("neurips", "columns", "1"), ("neurips", "size", "10"), ("baylearn", "limit", "2"), ("arr", "limit", "8"), ("iclr", "limit", "9")]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


@add(
    "profile_inheritance",
    f"""WITH RECURSIVE e AS (SELECT * FROM {_values(_EDGES)} t(profile, parent)), s AS (SELECT * FROM {_values(_LEAVES)} t(profile, path, value)),
    r AS (SELECT profile, profile AS owner, 0 AS steps FROM (SELECT profile FROM s UNION SELECT profile FROM e) UNION ALL SELECT r.profile, e.parent, r.steps + 1 FROM r JOIN e ON r.owner = e.profile)
    SELECT r.profile, s.path, arg_min(s.value, r.steps) AS value FROM r JOIN s ON s.profile = r.owner GROUP BY 1, 2""",
)
def profile_inheritance(spark: SparkSession, d: str) -> DataFrame:
    return config.inheritance(spark.createDataFrame(_EDGES, "profile string, parent string"), spark.createDataFrame(_LEAVES, "profile string, path string, value string"))


@add("profile_settings")
def profile_settings(spark: SparkSession, d: str) -> DataFrame:
    return config.settings_table(spark, PROFILES)


@add("profile_lineage")
def profile_lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, " < ".join(config.resolved(k, PROFILES)["lineage"]), len(CHECKS.selected(config.resolved(k, PROFILES), frozenset({"refcheck"})))) for k in PROFILES]
    return spark.createDataFrame(rows, "profile string, lineage string, n_checks int")


@add("check_listing")
def check_listing(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c.module, c.id, c.title, c.order) for c in CHECKS.checks.values()], "module string, check_id string, title string, ord int")


RUNS = "(SELECT DISTINCT ON (run_id) * FROM cached_runs)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cached_runs").dropDuplicates(["run_id"]).select("run_id", "path", "doc_id", "conference", "track", "saved_at")


@add("latest_runs", f"SELECT run_id, path, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY saved_at DESC, run_id) AS n FROM {RUNS}) WHERE n = 1")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_runs(_runs(spark, d)).select("run_id", "path", "saved_at")


@add("newest_runs", f"SELECT run_id, saved_at FROM {RUNS} ORDER BY saved_at DESC, run_id LIMIT 20")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    return store.newest(_runs(spark, d)).select("run_id", "saved_at")


@add("pruned_runs", f"SELECT run_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY saved_at DESC, run_id) AS n FROM {RUNS}) WHERE n > 1")
def pruned_runs(spark: SparkSession, d: str) -> DataFrame:
    return store.pruned(_runs(spark, d), 1).select("run_id")


@add("runs_by_conference", f"SELECT conference, track, count(*) AS n, count(DISTINCT doc_id) AS docs, max(saved_at) AS latest FROM {RUNS} GROUP BY ALL")
def runs_by_conference(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("conference", "track").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("saved_at").alias("latest"))


@add("verdict_counts", "SELECT run_id, count(*) AS n, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (author_score < 0) AS unknown_authors, round(avg(score), 6) AS score FROM (SELECT DISTINCT ON (verdict_id) * FROM verdicts) GROUP BY 1")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verdicts").dropDuplicates(["verdict_id"])
    return v.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("author_score") < 0).alias("unknown_authors"), F.round(F.avg("score"), 6).alias("score"))


_FIELDS = ["doi", "arxiv", "url", "authors", "pages", "year", "venue", "version", "registration"]


@add(
    "discrepancy_order",
    "SELECT verdict_id, pos, field, row_number() OVER (PARTITION BY verdict_id ORDER BY list_position(['doi', 'arxiv', 'url', 'authors', 'pages', 'year', 'venue', 'version', 'registration'], field) NULLS FIRST, pos) AS rank FROM (SELECT DISTINCT verdict_id, CAST(i - 1 AS INTEGER) AS pos, discrepancies->>('$[' || (i - 1) || '].field') AS field FROM (SELECT verdict_id, CAST(discrepancies AS JSON) AS discrepancies FROM verdicts WHERE json_valid(discrepancies) AND starts_with(discrepancies, '[')), generate_series(1, CAST(json_array_length(discrepancies) AS BIGINT)) g(i)) WHERE field IS NOT NULL",
)
def discrepancy_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, d, "verdicts").filter(F.try_parse_json("discrepancies").isNotNull() & F.col("discrepancies").startswith("["))
    v = v.select("verdict_id", F.from_json("discrepancies", "array<struct<field string>>").alias("x"))
    p = v.select("verdict_id", F.posexplode("x").alias("pos", "s")).select("verdict_id", "pos", "s.field").filter("field IS NOT NULL").distinct()
    rank = F.array_position(F.array(*[F.lit(f) for f in _FIELDS]), F.col("field"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("verdict_id").orderBy(rank, "pos")))
