"""Queries over running text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import sequences as S
from quire.operators import text_views as V
from quire.querybook import book
from quire.sources.projections import duck, projection
from quire.sources.tables import table

QUERIES, ORACLE, add = book()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL")


_CLEAN = r"""trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*[0-9]{1,4}\s*$')), chr(10)), '([0-9A-Za-z_])-\n([0-9A-Za-z_])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))"""


@add("clean_text", f"SELECT doc_id, length({_CLEAN}) AS n_chars, md5({_CLEAN}) AS digest FROM documents WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    t = V.clean_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(t).cast("bigint").alias("n_chars"), F.md5(t).alias("digest"))


_ENDS = r"(?:^|[\s(])(?:" + "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS) + r")$"
# Split marks take the place of the look-arounds that RE2 lacks.
SENT = rf"""(WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS para, unnest(ps) AS p FROM (SELECT doc_id, regexp_split_to_array(t, '\n\s*\n') AS ps FROM c)),
f AS (SELECT doc_id, para, string_split(regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g'), ' '), '([.!?])\s+([A-Z(\\$])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM p),
k AS (SELECT doc_id, para, generate_subscripts(ss, 1) - 1 AS k, unnest(ss) AS s FROM f),
g AS (SELECT *, sum(CASE WHEN coalesce(regexp_matches(before, '{_ENDS}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, para ORDER BY k) AS g FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id, para ORDER BY k) AS before FROM k)),
m AS (SELECT doc_id, para, g, string_agg(s, ' ' ORDER BY k) AS sentence FROM g GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, g) AS pos, sentence, len(string_split(sentence, ' ')) AS n_words, lower(regexp_extract(sentence, '^[^0-9A-Za-z_]*([0-9A-Za-z_]+)', 1)) AS opener FROM m
WHERE length(sentence) >= 25 AND len(list_filter(string_split(sentence, ' '), lambda x: regexp_matches(x, '^\p{{L}}+$'))) >= 4 AND NOT regexp_matches(sentence, '^(?:Figure|Fig\.|Table|Algorithm|Listing)\s+[A-Z]?[.0-9]+[:.]'))"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return V.sentences(_docs(spark, d), ["doc_id"])


@add("sentence_table", f"SELECT doc_id, pos, md5(sentence) AS digest, n_words, opener FROM {SENT}")
def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("sentence").alias("digest"), F.col("n_words").cast("bigint").alias("n_words"), "opener")


@add("sentence_length_histogram", f"SELECT CAST(least(floor(n_words / 10) * 10, 50) AS INTEGER) AS bucket, count(*) AS n FROM {SENT} GROUP BY 1")
def sentence_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return V.length_histogram(_sentences(spark, d))


@add("sentence_length_stats", f"SELECT doc_id, count(*) AS n, min(n_words) AS least, max(n_words) AS most, round(avg(n_words), 6) AS mean FROM {SENT} GROUP BY 1")
def sentence_length_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).withColumn("n_words", F.col("n_words").cast("bigint"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_words").alias("least"), F.max("n_words").alias("most"), F.round(F.avg("n_words"), 6).alias("mean"))


@add("long_sentences", f"SELECT doc_id, pos, n_words, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, pos) AS rank FROM {SENT}) WHERE rank <= 8")
def long_sentences(spark: SparkSession, d: str) -> DataFrame:
    return V.longest(_sentences(spark, d), ["doc_id"]).select("doc_id", "pos", "n_words", "rank")


@add("sentence_length", f"SELECT doc_id, count(*) FILTER (n_words >= 46) AS hard, count(*) FILTER (n_words >= 36 AND n_words < 46) AS soft FROM {SENT} GROUP BY 1 HAVING count(*) FILTER (n_words >= 46) > 0")
def sentence_length(spark: SparkSession, d: str) -> DataFrame:
    g = _sentences(spark, d).groupBy("doc_id").agg(F.count_if(F.col("n_words") >= 46).alias("hard"), F.count_if((F.col("n_words") >= 36) & (F.col("n_words") < 46)).alias("soft"))
    return g.filter("hard > 0")


_IGNORE = ["the", "this", "we", "it", "in", "for", "to", "a", "as"]


@add(
    "repeated_openers",
    f"""SELECT doc_id, opener, min(pos) AS start, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, opener ORDER BY pos) AS i FROM {SENT}) WHERE opener <> ''
    GROUP BY doc_id, opener, i HAVING count(*) >= CASE WHEN opener IN ({", ".join(f"'{w}'" for w in _IGNORE)}) THEN 5 ELSE 3 END""",
)
def repeated_openers(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).withColumn("opener", F.nullif("opener", F.lit("")))
    found = S.runs(s, ["doc_id"], ["pos"], "opener", 3)
    return found.filter((F.col("length") >= 5) | ~F.col("opener").isin(_IGNORE))


_WORDS = ["however", "moreover", *V.CONNECTIVES]


@add(
    "connective_tics",
    f"""SELECT doc_id, n, n_words, round(n * 1000 / n_words, 4) AS per_1000 FROM (SELECT doc_id, sum(CASE WHEN regexp_matches(lower(sentence), '\\b(?:{"|".join(_WORDS)})\\b') AND NOT regexp_matches(sentence, '["“”‘’]') THEN 1 ELSE 0 END) AS n, sum(n_words) AS n_words FROM {SENT} GROUP BY 1)
    WHERE n >= 3 AND round(n * 1000 / n_words, 4) > 3.0""",
)
def connective_tics(spark: SparkSession, d: str) -> DataFrame:
    return V.rate(_sentences(spark, d), ["doc_id"], _WORDS)


_DEM = r"\b(?:This|These) (?:" + "|".join(V.DEMONSTRATIVE_VERBS) + r")\b"


@add("vague_demonstratives", f"SELECT doc_id, pos FROM {SENT} WHERE regexp_matches(sentence, '{_DEM}') AND NOT regexp_matches(sentence, '[\"“”‘’]') UNION ALL SELECT doc_id, -1 FROM {duck('planted_text')} WHERE regexp_matches(text, '(?i){_DEM}')")
def vague_demonstratives(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).filter(F.col("sentence").rlike(_DEM) & ~F.col("sentence").rlike('["“”‘’]')).select("doc_id", F.col("pos").cast("bigint").alias("pos"))
    planted = projection(spark, d, "planted_text").filter(F.col("text").rlike("(?i)" + _DEM)).select("doc_id", F.lit(-1).cast("bigint").alias("pos"))
    return s.unionByName(planted)


_WRAP = "|".join(V.WRAPUPS)


@add("hollow_wrapups", f"SELECT doc_id, regexp_extract(lower(text), '({_WRAP})', 1) AS phrase FROM {duck('planted_text')} WHERE regexp_matches(lower(text), '{_WRAP}') UNION ALL SELECT doc_id, regexp_extract(lower(text), '({_WRAP})', 1) FROM documents WHERE regexp_matches(lower(text), '{_WRAP}')")
def hollow_wrapups(spark: SparkSession, d: str) -> DataFrame:
    both = projection(spark, d, "planted_text").select("doc_id", "text").unionByName(_docs(spark, d).select("doc_id", "text"))
    return both.filter(F.lower("text").rlike(_WRAP)).select("doc_id", F.regexp_extract(F.lower("text"), f"({_WRAP})", 1).alias("phrase"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@add("anonymity_emails", f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_MAIL}'))) AS email FROM {duck('planted_text')}")
def anonymity_emails(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "planted_text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), 0)).alias("email")).select("doc_id", F.lower("email").alias("email")).distinct()


_ORCID = r"\b[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx]\b"


@add("anonymity_orcids", f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_ORCID}')) AS orcid FROM {duck('planted_text')}")
def anonymity_orcids(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "planted_text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_ORCID), 0)).alias("orcid")).distinct()


_URL = r"https?://[^\s<>\")\]]+"
_HOST = r"^https?://([^/]+)"


@add(
    "url_inventory",
    f"""SELECT DISTINCT doc_id, url, lower(regexp_extract(url, '{_HOST}', 1)) AS host, CASE WHEN contains(lower(url), 'anonymous') THEN 'anonymous' WHEN regexp_matches(lower(url), 'github\\.com|gitlab\\.com|huggingface\\.co') THEN 'identity' ELSE 'other' END AS class
    FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(replace(text, chr(10), ' '), '{_URL}')), '[.,;)]+$', '') AS url FROM {duck("planted_text")})""",
)
def url_inventory(spark: SparkSession, d: str) -> DataFrame:
    hits = projection(spark, d, "planted_text").select("doc_id", F.explode(F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(_URL), 0)).alias("url"))
    u = hits.select("doc_id", F.regexp_replace("url", "[.,;)]+$", "").alias("url"))
    kind = F.when(F.lower("url").contains("anonymous"), "anonymous").when(F.lower("url").rlike(r"github\.com|gitlab\.com|huggingface\.co"), "identity").otherwise("other")
    return u.select("doc_id", "url", F.lower(F.regexp_extract("url", _HOST, 1)).alias("host"), kind.alias("class")).distinct()


_SELF = [r"in our previous work", r"we have shown", r"our earlier (work|paper)", r"as we showed in"]


@add("anonymity_self_reference", f"SELECT DISTINCT doc_id, p AS pattern FROM {duck('planted_text')}, (SELECT unnest([{', '.join(repr(x) for x in _SELF)}]) AS p) WHERE regexp_matches(lower(text), p)")
def anonymity_self_reference(spark: SparkSession, d: str) -> DataFrame:
    return multi_match(projection(spark, d, "planted_text"), _SELF)


def multi_match(df: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, pattern): which of the patterns each text matches; one pass over the texts."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in patterns]))
    return df.select("doc_id", F.explode(hits).alias("pattern")).distinct()


# Wordings that address an automated reader.
INJECTIONS = [
    "ignore (all )?(the )?previous instructions", "ignore (all )?(the )?above instructions", "disregard (all )?(the )?(previous|prior|above) instructions",
    "if you are an? (ai|llm|language model|automated reviewer)", "as an ai (language )?model,? you (must|should)", "this paper (must|should) be accepted",
    "(recommend|give) (this paper )?(a )?(strong )?accept", "do not (mention|reveal|disclose) (this|these instructions)", "only (highlight|mention|discuss) the strengths",
    "include (all of )?the following phrases",
]


@add("hidden_prompt_injection", f"SELECT DISTINCT doc_id, p AS pattern FROM {duck('planted_text')}, (SELECT unnest([{', '.join(repr(x) for x in INJECTIONS)}]) AS p) WHERE regexp_matches(lower(text), p)")
def hidden_prompt_injection(spark: SparkSession, d: str) -> DataFrame:
    return multi_match(projection(spark, d, "planted_text"), INJECTIONS)


@add(
    "injection_obfuscation",
    f"""SELECT DISTINCT doc_id, how FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(regexp_replace(text, '[' || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || ']', '', 'g')), 'ignore (all )?(the )?previous instructions') AND NOT regexp_matches(lower(text), 'ignore (all )?(the )?previous instructions') THEN 'hidden characters' END AS how FROM {duck("planted_text")}
    UNION ALL SELECT doc_id, CASE WHEN regexp_matches(lower(decode(from_base64(r))), 'ignore (all )?(the )?previous instructions') THEN 'base64' END FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{{24,}}={{0,2}}')) AS r FROM {duck("planted_text")}) WHERE length(r) % 4 = 0) WHERE how IS NOT NULL""",
)
def injection_obfuscation(spark: SparkSession, d: str) -> DataFrame:
    t = projection(spark, d, "planted_text")
    rx = INJECTIONS[0]
    bare = F.regexp_replace("text", "[​‌‍⁠﻿]", "")
    hidden = t.filter(F.lower(bare).rlike(rx) & ~F.lower("text").rlike(rx)).select("doc_id", F.lit("hidden characters").alias("how"))
    runs = t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{24,}={0,2}"), 0)).alias("r"))
    decoded = F.try_to_binary("r", F.lit("base64"))
    coded = runs.filter(F.lower(F.when(F.is_valid_utf8(decoded.cast("string")), decoded.cast("string"))).rlike(rx)).select("doc_id", F.lit("base64").alias("how"))
    return hidden.unionByName(coded).distinct()


@add("p_value_zero", rf"SELECT doc_id, regexp_extract(text, 'p [=<] (0?\.0+)\.', 1) AS value FROM {duck('stats_text')} WHERE regexp_matches(text, 'p [=<] 0?\.0+\.$')")
def p_value_zero(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "stats_text").filter(F.col("text").rlike(r"p [=<] 0?\.0+(?![0-9])")).select("doc_id", F.regexp_extract("text", r"p [=<] (0?\.0+)(?![0-9])", 1).alias("value"))


@add(
    "p_value_format",
    rf"SELECT starts_with(v, '0') AS leading_zero, length(regexp_extract(v, '\.([0-9]+)', 1)) AS places, count(*) AS n FROM (SELECT regexp_extract(text, 'p [=<] ([0-9]*\.[0-9]+)', 1) AS v FROM {duck('stats_text')}) WHERE v <> '' GROUP BY 1, 2",
)
def p_value_format(spark: SparkSession, d: str) -> DataFrame:
    v = projection(spark, d, "stats_text").select(F.regexp_extract("text", r"p [=<] ([0-9]*\.[0-9]+)", 1).alias("v")).filter("v <> ''")
    return v.groupBy(F.col("v").startswith("0").alias("leading_zero"), F.length(F.regexp_extract("v", r"\.([0-9]+)", 1)).cast("bigint").alias("places")).agg(F.count("*").alias("n"))


_PCT = r"([0-9][0-9,]*) (?:of|out of) ([0-9][0-9,]*)[^.%]{0,40}?\(?([0-9]+(?:\.[0-9]+)?)\s*%"


@add(
    "percentage_arithmetic",
    f"""SELECT DISTINCT doc_id, part, whole, claimed, round(abs(100 * part / whole - claimed), 4) AS off FROM (SELECT doc_id, CAST(replace(regexp_extract(h, '{_PCT}', 1), ',', '') AS DOUBLE) AS part, CAST(replace(regexp_extract(h, '{_PCT}', 2), ',', '') AS DOUBLE) AS whole, CAST(regexp_extract(h, '{_PCT}', 3) AS DOUBLE) AS claimed
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_PCT}')) AS h FROM {duck("stats_text")})) WHERE whole > 0 AND part <= whole AND round(abs(100 * part / whole - claimed), 4) > 0.55""",
)
def percentage_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return V.percentage_claims(projection(spark, d, "stats_text"), ["doc_id"])


@add(
    "decimal_precision",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9A-Za-z.])([0-9]+(?:\\.[0-9]+)?)', 1)) AS h FROM documents), v AS (SELECT doc_id, replace(h, '%', '') AS v FROM t),
    g AS (SELECT doc_id, CASE WHEN contains(v, '.') THEN length(string_split(v, '.')[2]) ELSE 0 END AS places, count(*) AS n, min(CAST(v AS DOUBLE)) AS low, max(CAST(v AS DOUBLE)) AS high FROM v GROUP BY 1, 2 HAVING count(*) >= 2),
    w AS (SELECT *, lead(low) OVER (PARTITION BY doc_id ORDER BY low, places) AS nl, lag(high) OVER (PARTITION BY doc_id ORDER BY low, places) AS ph FROM g) SELECT doc_id, places, n, low, high FROM w WHERE nl <= high OR ph >= low""",
)
def decimal_precision(spark: SparkSession, d: str) -> DataFrame:
    v = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9A-Za-z.])([0-9]+(?:\.[0-9]+)?)"), 1)).alias("h")).select("doc_id", F.replace("h", F.lit("%"), F.lit("")).alias("v"))
    return S.precision_groups(v, ["doc_id"], "v").withColumn("places", F.col("places").cast("bigint"))


@add("equation_lines", r"SELECT doc_id, i - 1 AS line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(s) <= 220 AND regexp_matches(s, '[=≤≥∑∏∫√]|\\(sum|frac|alpha|mathcal)') AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) <= 0.75 * length(s)")
def equation_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    math = F.col("s").rlike(r"[=≤≥∑∏∫√]|\\(sum|frac|alpha|mathcal)")
    return lines.filter((F.length("s") <= 220) & math & (F.length(F.regexp_replace("s", "[^A-Za-z]", "")) <= 0.75 * F.length("s"))).select("doc_id", F.col("line").cast("bigint").alias("line"))


@add("figure_callouts", f"SELECT doc_id, kind, label, page FROM {duck('captions')} c WHERE NOT EXISTS (SELECT 1 FROM {duck('callouts')} o WHERE o.doc_id = c.doc_id AND o.kind = c.kind AND o.label = c.label)")
def figure_callouts(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "captions").join(projection(spark, d, "callouts"), ["doc_id", "kind", "label"], "left_anti").select("doc_id", "kind", "label", "page")


@add("dangling_callouts", f"SELECT DISTINCT doc_id, page, kind, label FROM {duck('callouts')} o WHERE NOT EXISTS (SELECT 1 FROM {duck('captions')} c WHERE o.doc_id = c.doc_id AND o.kind = c.kind AND o.label = c.label)")
def dangling_callouts(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "callouts").join(projection(spark, d, "captions"), ["doc_id", "kind", "label"], "left_anti").select("doc_id", "page", "kind", "label").distinct()


@add("callouts_in_text", r"SELECT doc_id, lower(regexp_extract(h, '(Figure|Table|Section) ', 1)) AS kind, CAST(regexp_extract(h, '([0-9]+)', 1) AS INTEGER) AS number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:Figure|Table|Section) [0-9]+')) AS h FROM documents) GROUP BY 1, 2, 3")
def callouts_in_text(spark: SparkSession, d: str) -> DataFrame:
    h = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:Figure|Table|Section) [0-9]+"), 0)).alias("h"))
    return h.groupBy("doc_id", F.lower(F.regexp_extract("h", "(Figure|Table|Section) ", 1)).alias("kind"), F.regexp_extract("h", "([0-9]+)", 1).cast("int").alias("number")).agg(F.count("*").alias("n"))


@add(
    "caption_numbering",
    f"""WITH c AS (SELECT DISTINCT doc_id, kind, CAST(label AS INTEGER) AS n FROM {duck("captions")}), w AS (SELECT *, lead(n) OVER (PARTITION BY doc_id, kind ORDER BY n) AS nx FROM c)
    SELECT doc_id, kind, unnest(generate_series(n + 1, nx - 1)) AS missing FROM w WHERE nx - n > 1""",
)
def caption_numbering(spark: SparkSession, d: str) -> DataFrame:
    c = projection(spark, d, "captions").select("doc_id", "kind", F.col("label").cast("int").alias("n"))
    return S.number_gaps(c, ["doc_id", "kind"], "n").withColumn("missing", F.col("missing").cast("bigint"))


@add(
    "caption_completeness",
    rf"""SELECT doc_id, kind, label, CASE WHEN len(string_split(text, ' ')) < 8 THEN 'short' ELSE 'unexplained numbers' END AS problem FROM {duck("captions")}
    WHERE len(string_split(text, ' ')) < 8 OR (len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) >= 2 AND NOT regexp_matches(lower(text), 'score|error|rate|higher|lower|better'))""",
)
def caption_completeness(spark: SparkSession, d: str) -> DataFrame:
    c = projection(spark, d, "captions")
    short = F.size(F.split("text", " ")) < 8
    bare = (F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)) >= 2) & ~F.lower("text").rlike("score|error|rate|higher|lower|better")
    return c.filter(short | bare).select("doc_id", "kind", "label", F.when(short, "short").otherwise("unexplained numbers").alias("problem"))


@add("duplicate_labels", f"SELECT doc_id, kind, label, count(*) AS n FROM {duck('callouts')} GROUP BY ALL HAVING count(*) > 1")
def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    return projection(spark, d, "callouts").groupBy("doc_id", "kind", "label").agg(F.count("*").alias("n")).filter("n > 1")


@add(
    "abbreviation_defined",
    f"""SELECT doc_id, token, uses FROM (SELECT doc_id, token, count(*) AS uses, min(text) AS text FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '\\b([A-Z]{{2,6}})\\b', 1)) AS token FROM {duck("planted_text")}) GROUP BY 1, 2) t
    WHERE uses >= 2 AND (NOT contains(text, '(' || token || ')') OR strpos(text, token) < strpos(text, '(' || token || ')'))""",
)
def abbreviation_defined(spark: SparkSession, d: str) -> DataFrame:
    t = V.definitions(projection(spark, d, "planted_text"), ["doc_id"])
    return t.filter((F.col("uses") >= 2) & (F.col("defined_at").isNull() | (F.col("first_use") < F.col("defined_at")))).select("doc_id", "token", "uses")


_ANS = r"\[(Yes|No|N/A|TODO)\]"


@add(
    "checklist_answers",
    rf"""SELECT doc_id, regexp_extract(h, '^([A-Z][0-9]+)', 1) AS code, lower(regexp_extract(h, '{_ANS}', 1)) AS answer FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][0-9]+\. [^\n]*\n{_ANS}')) AS h FROM documents WHERE source = 'checklist')""",
)
def checklist_answers(spark: SparkSession, d: str) -> DataFrame:
    rx = rf"[A-Z][0-9]+\. [^\n]*\n{_ANS}"
    h = _docs(spark, d).filter("source = 'checklist'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rx), 0)).alias("h"))
    return h.select("doc_id", F.regexp_extract("h", "^([A-Z][0-9]+)", 1).alias("code"), F.lower(F.regexp_extract("h", _ANS, 1)).alias("answer"))


@add(
    "checklist_coverage",
    f"""SELECT doc_id, count(*) FILTER (answer = 'yes') AS yes, count(*) FILTER (answer = 'no') AS no, count(*) FILTER (answer = 'n/a') AS na, count(*) FILTER (answer = 'todo') AS todo,
    CASE WHEN count(*) FILTER (answer <> 'n/a') > 0 THEN round(count(*) FILTER (answer = 'yes') / count(*) FILTER (answer <> 'n/a'), 6) END AS coverage FROM ({ORACLE["checklist_answers"]}) GROUP BY doc_id""",
)
def checklist_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = checklist_answers(spark, d)
    counts = [F.count_if(F.col("answer") == v).alias(k) for v, k in (("yes", "yes"), ("no", "no"), ("n/a", "na"), ("todo", "todo"))]
    applicable = F.count_if(F.col("answer") != "n/a")
    return a.groupBy("doc_id").agg(*counts, F.when(applicable > 0, F.round(F.count_if(F.col("answer") == "yes") / applicable, 6)).alias("coverage"))


_FIND = r"\[(pass|skip|WARN|ERROR)\] ([a-z_]+) p\.([0-9]+):[^\n]*?\(measured ([0-9.]+), expected ≤ ([0-9.]+)\)"


@add(
    "report_findings",
    rf"""SELECT doc_id, lower(regexp_extract(h, '{_FIND}', 1)) AS severity, regexp_extract(h, '{_FIND}', 2) AS check_id, CAST(regexp_extract(h, '{_FIND}', 3) AS INTEGER) AS page, CAST(regexp_extract(h, '{_FIND}', 4) AS DOUBLE) AS measured, CAST(regexp_extract(h, '{_FIND}', 5) AS DOUBLE) AS expected
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_FIND}')) AS h FROM documents WHERE source = 'report')""",
)
def report_findings(spark: SparkSession, d: str) -> DataFrame:
    h = _docs(spark, d).filter("source = 'report'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_FIND), 0)).alias("h"))
    get = lambda k: F.regexp_extract("h", _FIND, k)
    return h.select("doc_id", F.lower(get(1)).alias("severity"), get(2).alias("check_id"), get(3).cast("int").alias("page"), get(4).cast("double").alias("measured"), get(5).cast("double").alias("expected"))


@add("section_carry_forward", f"SELECT doc_id, line, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT doc_id, i - 1 AS line, CASE WHEN regexp_matches(s, '^[0-9]+(\\.[0-9]+)* [A-Z]') THEN regexp_extract(s, '^([0-9.]+)', 1) END AS h FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE source = 'paper_body')))")
def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).filter("source = 'paper_body'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    marked = lines.select("doc_id", F.col("line").cast("bigint").alias("line"), F.when(F.col("s").rlike(r"^[0-9]+(\.[0-9]+)* [A-Z]"), F.regexp_extract("s", "^([0-9.]+)", 1)).alias("h"))
    return S.carry_forward(marked, ["doc_id"], ["line"], "h", "section").select("doc_id", "line", "section")


@add("model_context", "SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 4000 THEN md5(substr(text, 1, 2400) || ' [...] ' || substr(text, length(text) - 1599)) ELSE md5(text) END AS digest, length(text) > 4000 AS cut FROM documents WHERE text IS NOT NULL")
def model_context(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    cut = F.concat(F.substring("text", 1, 2400), F.lit(" [...] "), F.col("text").substr(n - 1599, F.lit(1600)))
    return _docs(spark, d).select("doc_id", n.cast("bigint").alias("n"), F.md5(F.when(n > 4000, cut).otherwise(F.col("text"))).alias("digest"), (n > 4000).alias("cut"))


@add("run_ids", "SELECT doc_id, left(sha256(path), 8) AS run_id FROM (SELECT DISTINCT doc_id, path FROM docs)")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("doc_id", "path").distinct().select("doc_id", C.run_id(F.col("path")).alias("run_id"))
