"""The checks of the catalogue that read the test tables, registered by module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import outline as O
from quire.operators import sequences as S
from quire.operators import text_views as V
from quire.plans.config import setting
from quire.plans import specs
from quire.plans.registry import Registry, Views

CHECKS = Registry()
Tables = Views


def _found(df: DataFrame, severity: str, message, **more) -> DataFrame:
    return df.select("doc_id", F.lit(severity).alias("severity"), message.alias("message"), *[v.alias(k) for k, v in more.items()])


def _sentences(tables: Tables) -> DataFrame:
    return tables.view("sentences", lambda: V.sentences(tables("documents").filter("text IS NOT NULL"), ["doc_id"]))


def _spans(tables: Tables) -> DataFrame:
    return tables.view("spans", lambda: L.delivered_once(tables("spans")))


def _lines(tables: Tables) -> DataFrame:
    return tables.view("lines", lambda: L.lines(_spans(tables)))


def _body(tables: Tables) -> DataFrame:
    return tables.view("body", lambda: L.body_font_size(_spans(tables)))


def _structure(tables: Tables, profile: dict) -> DataFrame:
    tracks = profile.get("tracks") or {}
    limit = tracks.get(profile.get("default_track"), next(iter(tracks.values()), {})).get("limit")

    def make() -> DataFrame:
        heads = O.outline(_lines(tables))
        found = O.findings(O.placed(_lines(tables), heads), heads, limit or 0)
        return found if limit else found.filter("check <> 'page_limit'")

    return tables.view("structure", make)


@CHECKS.register("sentence_length", "Sentence length", module="core.prose", category="prose", order=40)
def sentence_length(tables: Tables, profile: dict) -> DataFrame:
    hard = setting(profile, "prose.sentence_hard_max_words", 46)
    long = _sentences(tables).filter(F.col("n_words") >= hard)
    return _found(long, "warning", F.format_string("sentence of %d words", F.col("n_words")), measured=F.col("n_words").cast("double"), quote=F.substring("sentence", 1, 140))


@CHECKS.register("repeated_openers", "Repeated openers", module="core.prose", category="prose", order=41)
def repeated_openers(tables: Tables, profile: dict) -> DataFrame:
    least = setting(profile, "prose.repeated_opener_run", 3)
    ignored = setting(profile, "prose.repeated_opener_ignore", [])
    runs = S.runs(_sentences(tables).withColumn("opener", F.nullif("opener", F.lit(""))), ["doc_id"], ["pos"], "opener", least)
    runs = runs.filter(~F.col("opener").isin(ignored) | (F.col("length") > least + 1)) if ignored else runs
    return _found(runs, "warning", F.format_string("%d sentences in a row open with '%s'", F.col("length"), F.col("opener")), measured=F.col("length").cast("double"))


@CHECKS.register("connective_tics", "Connective overuse", module="core.prose", category="prose", order=60)
def connective_tics(tables: Tables, profile: dict) -> DataFrame:
    most = setting(profile, "prose.connective_per_1000", 3.0)
    hits = V.rate(_sentences(tables), ["doc_id"], setting(profile, "prose.connectives", V.CONNECTIVES), over=most)
    return _found(hits, "warning", F.format_string("%d sentences with stock connectives", F.col("n")), measured=F.col("per_1000"))


@CHECKS.register("vague_demonstratives", "Vague demonstratives", module="core.prose", category="prose", order=61)
def vague_demonstratives(tables: Tables, profile: dict) -> DataFrame:
    rx = r"\b(?:This|These) (?:" + "|".join(V.DEMONSTRATIVE_VERBS) + r")\b"
    hits = _sentences(tables).filter(F.col("sentence").rlike(rx) & ~F.col("sentence").rlike('["“”‘’]'))
    return _found(hits, "warning", F.lit("a demonstrative without a noun"), quote=F.substring("sentence", 1, 140))


@CHECKS.register("hollow_wrapups", "Hollow wrap-ups", module="core.prose", category="prose", order=62)
def hollow_wrapups(tables: Tables, profile: dict) -> DataFrame:
    hits = _sentences(tables).filter(F.lower("sentence").rlike("|".join(V.WRAPUPS)))
    return _found(hits, "warning", F.lit("a stock wrap-up"), quote=F.substring("sentence", 1, 140))


@CHECKS.register("percentage_arithmetic", "Percentage arithmetic", module="core.statistics", category="statistics", order=42)
def percentage_arithmetic(tables: Tables, profile: dict) -> DataFrame:
    hits = V.percentage_claims(tables("documents").filter("text IS NOT NULL"), ["doc_id"])
    return _found(hits, "warning", F.format_string("%.0f of %.0f is not %.2f %%", F.col("part"), F.col("whole"), F.col("claimed")), measured=F.col("off"))


@CHECKS.register("body_font_size", "Body font size", module="core.fonts", category="format", order=20)
def body_font_size(tables: Tables, profile: dict) -> DataFrame:
    allowed = setting(profile, "fonts.body_sizes_pt", [10.0, 11.0])
    s = _body(tables)
    ok = F.exists(F.array(*[F.lit(float(a)) for a in allowed]), lambda a: F.abs(F.col("size") - a) <= 0.6)
    return s.select("doc_id", F.when(ok, "pass").otherwise("error").alias("severity"), F.format_string("body text is set in %.1f pt", F.col("size")).alias("message"), F.col("size").alias("measured"))


@CHECKS.register("min_font_size", "Smallest font size", module="core.fonts", category="format", order=21)
def min_font_size(tables: Tables, profile: dict) -> DataFrame:
    least = setting(profile, "fonts.min_size_pt", 8.0)
    small = _spans(tables).filter((F.length(F.trim("text")) >= 3) & (F.col("size") < least - 0.15) & ~L.is_invisible(F.col("render_mode"), F.col("opacity")))
    g = small.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    return _found(g, "warning", F.format_string("%d parts below %.1f pt", F.col("n"), F.lit(float(least))), measured=F.col("size"), page=F.col("page"))


@CHECKS.register("margins", "Margins", module="core.geometry", category="format", order=11)
def margins(tables: Tables, profile: dict) -> DataFrame:
    m = {k: float(setting(profile, f"margins.{k}_pt", v)) for k, v in (("left", 71), ("right", 71), ("top", 57), ("bottom", 62))}
    over = L.margin_overshoots(L.body_lines(_lines(tables)), **m)
    g = over.groupBy("doc_id", "page", "side").agg(F.count("*").alias("n"), F.max("over").alias("over"))
    return _found(g, "error", F.format_string("%d lines beyond the %s margin", F.col("n"), F.col("side")), measured=F.col("over"), page=F.col("page"))


@CHECKS.register("heading_hierarchy", "Heading numbers", module="core.headings", category="structure", order=37)
def heading_hierarchy(tables: Tables, profile: dict) -> DataFrame:
    bad = S.numbering_problems(L.headings(_lines(tables), _body(tables)))
    return _found(bad, "warning", F.concat_ws(": ", "numbering", "problem"), page=F.col("page"))


@CHECKS.register("hidden_invisible_text", "Invisible text", module="core.hidden", category="integrity", order=60)
def hidden_invisible_text(tables: Tables, profile: dict) -> DataFrame:
    seen = _spans(tables).filter(L.is_invisible(F.col("render_mode"), F.col("opacity")) & F.col("text").rlike("[A-Za-z]"))
    g = seen.groupBy("doc_id", "page").agg(F.sum(F.length(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("n"))
    return g.select("doc_id", F.when(F.col("n") > 40, "error").otherwise("warning").alias("severity"), F.format_string("%d letters drawn with no ink", F.col("n")).alias("message"), F.col("n").cast("double").alias("measured"), "page")


@CHECKS.register("pdf_health", "File health", module="core.pdf", category="integrity", order=92)
def pdf_health(tables: Tables, profile: dict) -> DataFrame:
    docs = tables("docs").dropDuplicates(["doc_id"])
    what = F.array_compact(F.array(F.when(F.col("is_encrypted"), F.lit("the file is encrypted")), F.when(F.col("is_repaired"), F.lit("the file had to be repaired")), F.when(F.col("page_count").isNull(), F.lit("no page count"))))
    return _found(docs.select("doc_id", F.explode(what).alias("w")), "warning", F.col("w"))


@CHECKS.register("reference_parsing", "Bibliography parsing", module="integrations.refcheck", category="references", order=88, requires=("refcheck",))
def reference_parsing(tables: Tables, profile: dict) -> DataFrame:
    b = tables("bib_entries").dropDuplicates(["entry_id"]).filter("title IS NULL AND doi IS NULL AND arxiv_id IS NULL")
    return _found(b, "warning", F.format_string("entry %d could not be parsed", F.col("entry_no")), quote=F.substring("raw", 1, 140))


@CHECKS.register("reference_verification", "Reference verification", module="integrations.refcheck", category="references", order=89, requires=("refcheck",))
def reference_verification(tables: Tables, profile: dict) -> DataFrame:
    v = tables("verdicts").dropDuplicates(["verdict_id"]).filter(F.col("status").isin(*setting(profile, "refcheck.suspicious", ["not_found", "author_mismatch", "error"])))
    runs = tables("cached_runs").dropDuplicates(["run_id"]).select("run_id", "doc_id")
    return _found(v.join(runs, "run_id"), "error", F.concat_ws(" ", F.lit("reference is"), "status"), measured=F.col("score"))


@CHECKS.register("rnlp_summary", "Checklist coverage", module="arr.responsible_nlp", category="checklist", order=299)
def rnlp_summary(tables: Tables, profile: dict) -> DataFrame:
    rx = r"[A-Z][0-9]+\. [^\n]*\n\[(?:Yes|No|N/A|TODO)\]"
    h = tables("documents").filter("source = 'checklist' AND text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rx), 0)).alias("h"))
    g = h.groupBy("doc_id").agg(F.count_if(F.col("h").endswith("[Yes]")).alias("yes"), F.count_if(~F.col("h").endswith("[N/A]")).alias("all"))
    share = F.col("yes") / F.col("all")
    return g.filter("all > 0").select("doc_id", F.when(share < 0.5, "error").otherwise("warning").alias("severity"), F.format_string("%d of %d answered yes", F.col("yes"), F.col("all")).alias("message"), F.round(share, 4).alias("measured"))


def _section_check(id: str, title: str, order: int, what: str) -> None:
    @CHECKS.register(id, title, module="core.structure", category="structure", order=order)
    def check(tables: Tables, profile: dict) -> DataFrame:
        own = _structure(tables, profile).filter(F.col("check") == id)
        return own.select("doc_id", "severity", F.when(F.col("page").isNull(), F.lit(f"{what}: not found")).otherwise(F.format_string(f"{what}: page %d", F.col("page"))).alias("message"), "page")


for _id, _title, _order, _what in (
    ("page_limit", "Content pages", 29, "last page of content"), ("limitations_present", "Limitations section", 31, "Limitations"), ("limitations_position", "Limitations placement", 32, "Limitations"),
    ("references_position", "References placement", 34, "References"), ("appendix_position", "Appendix placement", 35, "Appendix"),
):
    _section_check(_id, _title, _order, _what)


@CHECKS.register("anonymity_emails", "E-mail addresses", module="core.anonymity", category="anonymity", order=51)
def anonymity_emails(tables: Tables, profile: dict) -> DataFrame:
    ignored = "|".join(setting(profile, "anonymity.email_ignore_regexes", [r"@example\.(com|org)$"]))
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)))
    hits = tables("documents").filter("text IS NOT NULL").select("doc_id", found.alias("m")).filter(~F.col("m").rlike(ignored))
    return _found(hits, "error", F.concat(F.lit("an e-mail address: "), "m"), quote=F.col("m"))


@CHECKS.register("anonymity_orcids", "ORCID ids", module="core.anonymity", category="anonymity", order=52)
def anonymity_orcids(tables: Tables, profile: dict) -> DataFrame:
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b"), 1)))
    hits = tables("documents").filter("text IS NOT NULL").select("doc_id", found.alias("m"))
    return _found(hits, "error", F.concat(F.lit("an ORCID id: "), "m"), quote=F.col("m"))


specs.register(CHECKS)
