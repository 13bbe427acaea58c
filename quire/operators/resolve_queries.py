"""Reference resolution over bibliography entries and records, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import resolve as R
from quire.querybook import book
from quire.sources.projections import duck, projection
from quire.sources.tables import table

QUERIES, ORACLE, add = book()


def _bib(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bib_entries").dropDuplicates(["entry_id"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").dropDuplicates(["record_id"])


BIB = "(SELECT DISTINCT ON (entry_id) * FROM bib_entries)"
REC = "(SELECT DISTINCT ON (record_id) * FROM records)"


def duck_title(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({c}), '{C._ACCENTED}', '{C._PLAIN}'), '[^a-z0-9]+', ' ', 'g'), ' ')"


_STOP = ", ".join(f"'{w}'" for w in C.TITLE_STOPWORDS)


def duck_key(c: str) -> str:
    return f"array_to_string(list_filter(string_split({duck_title(c)}, ' '), lambda w: w NOT IN ({_STOP})), ' ')"


@add("title_keys", f"SELECT entry_id, {duck_title('title')} AS normal, {duck_key('title')} AS key, replace({duck_title('title')}, ' ', '') AS compact FROM {BIB} WHERE title IS NOT NULL")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return _bib(spark, d).filter("title IS NOT NULL").select("entry_id", C.normalised_title(t).alias("normal"), C.title_key(t).alias("key"), C.compact_title(t).alias("compact"))


_DOI = r"(10\.[0-9]{4,9}/[^\s\"<>]+)"


def duck_doi(c: str) -> str:
    t = rf"lower(regexp_replace(regexp_replace(trim({c}), '(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)', ''), '[.,;)\]}}]+$', ''))"
    return f"CASE WHEN starts_with({t}, '10.') AND contains({t}, '/') THEN {t} END"


@add(
    "identifier_scan",
    rf"""SELECT entry_id, {duck_doi(f"nullif(regexp_extract(raw, '{_DOI}', 1), '')")} AS doi, nullif(regexp_extract(raw, '(?i)arxiv[:\s]*([0-9]{{4}}\.[0-9]{{4,5}})', 1), '') AS arxiv,
    CAST(list_min(list_transform(regexp_extract_all(raw, '\b((?:19|20)[0-9]{{2}})\b', 1), lambda y: CAST(y AS INTEGER))) AS INTEGER) AS year FROM {BIB} WHERE raw IS NOT NULL""",
)
def identifier_scan(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("raw")
    return _bib(spark, d).filter("raw IS NOT NULL").select("entry_id", C.found_doi(r).alias("doi"), C.found_arxiv(r).alias("arxiv"), C.found_year(r).alias("year"))


@add(
    "page_ranges",
    r"""WITH p AS (SELECT record_id, regexp_extract(pages, '^\s*([0-9]+)(?:\s*[-‐‑‒–—−]+\s*([0-9]+))?', 1) AS a, regexp_extract(pages, '^\s*([0-9]+)(?:\s*[-‐‑‒–—−]+\s*([0-9]+))?', 2) AS b FROM """
    + REC
    + r""" WHERE pages IS NOT NULL), q AS (SELECT record_id, a, CASE WHEN length(b) > 0 AND length(b) < length(a) AND TRY_CAST(b AS BIGINT) < TRY_CAST(a AS BIGINT) THEN left(a, length(a) - length(b)) || b ELSE b END AS b FROM p)
    SELECT record_id, CASE WHEN length(a) > 0 THEN coalesce(nullif(ltrim(a, '0'), ''), '0') END AS first, CASE WHEN length(b) > 0 THEN coalesce(nullif(ltrim(b, '0'), ''), '0') END AS last FROM q""",
)
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    first, last = C.page_range(F.col("pages"))
    return _records(spark, d).filter("pages IS NOT NULL").select("record_id", first.alias("first"), last.alias("last"))


@add("printed_pages", rf"SELECT entry_id, nullif(regexp_extract(raw, '(?i)(?:pages|pp\.?)\s*([0-9]+\s*[-–—]+\s*[0-9]+)', 1), '') AS pages FROM {BIB} WHERE regexp_matches(raw, '(?i)(?:pages|pp\.?)\s*([0-9]+\s*[-–—]+\s*[0-9]+)')")
def printed_pages(spark: SparkSession, d: str) -> DataFrame:
    return _bib(spark, d).select("entry_id", C.printed_pages(F.col("raw")).alias("pages")).filter("pages IS NOT NULL")


def _kind_sql() -> str:
    out = "CASE WHEN doi IS NOT NULL THEN 'paper' WHEN arxiv_id IS NOT NULL THEN 'preprint'"
    for host, kind in C.HOST_KINDS:
        out += f" WHEN contains(lower(coalesce(url, '')), '{host}') THEN '{kind}'"
    text = "lower(concat_ws(' ', raw, venue))"
    for kind, hints in C.WORD_KINDS:
        tests = []
        for h in hints:
            quoted = h.replace("'", "''")
            tests.append(f"contains({text}, '{quoted}')")
        out += f" WHEN {' OR '.join(tests)} THEN '{kind}'"
    return out + " WHEN coalesce(url, '') <> '' THEN 'web' ELSE 'unknown' END"


@add("reference_kinds", f"SELECT {_kind_sql()} AS kind, count(*) AS n FROM {BIB} GROUP BY 1")
def reference_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = C.reference_kind(F.col("raw"), F.col("venue"), F.col("doi"), F.col("arxiv_id"), F.col("url"))
    return _bib(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@add(
    "preprint_flags",
    f"""SELECT record_id, coalesce(preprint, coalesce(regexp_matches(lower(doi), '^(10\\.48550/|10\\.1101/|10\\.2139/ssrn|10\\.31219/|10\\.20944/preprints|10\\.21203/rs\\.|10\\.36227/techrxiv|10\\.26434/chemrxiv)'), false)
    OR coalesce(regexp_matches(venue, '(?i)\\b(arxiv|corr|ssrn|preprint)\\b|biorxiv|medrxiv|techrxiv|chemrxiv|research square|submitted to|not accepted'), false)) AS preprint FROM {REC}""",
)
def preprint_flags(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", C.is_preprint(F.col("preprint"), F.col("doi"), F.col("venue")).alias("preprint"))


def duck_surname(c: str) -> str:
    words = rf"list_filter(string_split_regex(trim(regexp_replace({c}, '[^\p{{L}}\p{{N}}\s]+', ' ', 'g')), '\s+'), lambda w: length(w) > 1)"
    a, b = duck_title(f"string_split({c}, ',')[1]"), duck_title(f"coalesce(({words})[-1], '')")
    return f"CASE WHEN contains({c}, ',') THEN {a} ELSE {b} END"


@add("surnames", f"SELECT DISTINCT name, {duck_surname('name')} AS surname FROM (SELECT unnest(authors) AS name FROM {REC}) WHERE name IS NOT NULL")
def surnames(spark: SparkSession, d: str) -> DataFrame:
    names = _records(spark, d).select(F.explode("authors").alias("name")).filter("name IS NOT NULL").distinct()
    return names.select("name", C.surname(F.col("name")).alias("surname"))


@add(
    "reference_dedupe",
    f"""SELECT key, count(*) AS n, min(entry_id) AS first FROM (SELECT entry_id, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || arxiv_id WHEN {duck_key("coalesce(title, '')")} <> '' THEN 'title:' || {duck_key("title")} ELSE 'raw:' || md5(coalesce(raw, '')) END AS key FROM {BIB}) GROUP BY 1""",
)
def reference_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return R.dedupe_groups(_bib(spark, d))


_TOK = f"list_distinct(list_filter(string_split({{}}, ' '), lambda w: w NOT IN ({_STOP}) AND w <> ''))"


def _pairs_sql() -> str:
    """All candidates: word similarity of 0.5 or more, compact titles of one long start or at most one change apart, or one DOI."""
    fields = f"{_TOK.format(duck_title('title'))} AS t, list_distinct(list_filter(list_transform(authors, lambda n: {duck_surname('n')}), lambda s: s <> '')) AS s, replace({duck_title('title')}, ' ', '') AS k"
    return f"""(WITH e AS MATERIALIZED (SELECT entry_id, year, {fields}, {duck_doi("doi")} AS d FROM {BIB} WHERE title IS NOT NULL),
    r AS MATERIALIZED (SELECT record_id, year, {fields}, [{duck_doi("doi")}, {duck_doi("published_doi")}] AS d FROM {REC} WHERE title IS NOT NULL),
    w AS (SELECT entry_id, record_id, count(*) AS c FROM (SELECT entry_id, unnest(t) AS x FROM e) a JOIN (SELECT record_id, unnest(t) AS x FROM r) b ON a.x = b.x GROUP BY 1, 2),
    p AS (SELECT w.entry_id, w.record_id FROM w JOIN e ON e.entry_id = w.entry_id JOIN r ON r.record_id = w.record_id WHERE 0.5 * c / (len(e.t) + len(r.t) - c) + 0.5 * c / least(len(e.t), len(r.t)) >= 0.499999999
      UNION SELECT entry_id, record_id FROM e JOIN r ON left(e.k, 24) = left(r.k, 24) WHERE length(e.k) >= 24
      UNION SELECT entry_id, record_id FROM (SELECT entry_id, k, length(k) + unnest([-1, 0, 1]) AS n FROM e WHERE k <> '') x JOIN (SELECT record_id, k, length(k) AS n FROM r WHERE k <> '') y ON x.n = y.n AND levenshtein(x.k, y.k) <= 1
      UNION SELECT entry_id, record_id FROM e JOIN (SELECT record_id, unnest(d) AS d FROM r) x ON e.d = x.d)
    SELECT e.entry_id, r.record_id, e.year AS ey, r.year AS ry, len(list_intersect(e.t, r.t)) AS c, least(len(e.t), len(r.t)) AS l, len(list_distinct(list_concat(e.t, r.t))) AS u, e.s AS es, r.s AS rs
    FROM p JOIN e ON e.entry_id = p.entry_id JOIN r ON r.record_id = p.record_id)"""


_SCORED = f"""(SELECT *, CASE WHEN l > 0 THEN 0.5 * c / u + 0.5 * c / l ELSE 0.0 END AS score, CASE WHEN least(len(es), len(rs)) > 0 THEN len(list_intersect(es, rs)) / least(len(es), len(rs)) END AS authors FROM {_pairs_sql()})"""
_JUDGE = "CASE WHEN score < 0.72 THEN 'reject' WHEN abs(ey - ry) > 2 THEN 'review' WHEN score >= 0.9 THEN CASE WHEN authors < 0.34 THEN 'review' WHEN authors IS NULL AND score < 0.95 THEN 'review' ELSE 'accept' END ELSE 'review' END"


@add("candidate_judging", f"SELECT entry_id, record_id, round(score, 6) AS score, round(coalesce(authors, -1.0), 6) AS author_score, {_JUDGE} AS outcome FROM {_SCORED} WHERE score >= 0.5")
def candidate_judging(spark: SparkSession, d: str) -> DataFrame:
    # below that word similarity no pair is listed, however it came to be a candidate
    return R.judged(R.scored_candidates(_bib(spark, d), _records(spark, d), R.WORDS)).filter("score >= 0.5")


@add(
    "best_candidate",
    f"""SELECT entry_id, record_id, outcome, score FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY CASE outcome WHEN 'accept' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, score DESC, author_score DESC, record_id) AS n
    FROM (SELECT entry_id, record_id, round(score, 6) AS score, round(coalesce(authors, -1.0), 6) AS author_score, {_JUDGE} AS outcome FROM {_SCORED})) WHERE n = 1""",
)
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return R.best_candidates(_bib(spark, d), _records(spark, d)).select("entry_id", "record_id", "outcome", "score")


@add(
    "verdict_ladder",
    f"""SELECT status, count(*) AS n FROM (SELECT e.entry_id, CASE WHEN e.title IS NULL AND e.doi IS NULL AND e.arxiv_id IS NULL THEN 'unparsed' WHEN b.outcome = 'accept' THEN 'verified' WHEN b.outcome = 'review' AND b.author_score >= 0 AND b.author_score < 0.34 THEN 'author_mismatch'
    WHEN b.outcome = 'review' THEN 'unconfirmed' WHEN e.doi IS NOT NULL THEN 'unindexed' ELSE 'not_found' END AS status FROM {BIB} e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY CASE outcome WHEN 'accept' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, score DESC, author_score DESC, record_id) AS n
    FROM (SELECT entry_id, record_id, round(score, 6) AS score, round(coalesce(authors, -1.0), 6) AS author_score, {_JUDGE} AS outcome FROM {_SCORED})) WHERE n = 1) b ON e.entry_id = b.entry_id) GROUP BY 1""",
)
def verdict_ladder(spark: SparkSession, d: str) -> DataFrame:
    bib = _bib(spark, d)
    # a candidate below the review threshold is rejected, which says the same as none
    found = R.best(R.judged(R.scored_candidates(bib, _records(spark, d), R.REVIEW))).select("entry_id", "outcome", "author_score")
    return R.statuses(bib, found).groupBy("status").agg(F.count("*").alias("n"))


@add("title_similarity")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Blended similarity of candidate titles (sequence ratio in Arrow batches)."""
    return R.title_similarities(_bib(spark, d), _records(spark, d))


@add("author_alignment")
def author_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Greedy alignment of cited and recorded authors of best candidates."""
    return R.author_alignments(_bib(spark, d), _records(spark, d))


@add("citation_resolution", f"SELECT DISTINCT c.doc_id, name, year FROM (SELECT doc_id, lower(regexp_extract(text, '([A-Z][A-Za-z]*[0-9]*) et al', 1)) AS name, regexp_extract(text, '\\(([0-9]{{4}})\\)', 1) AS year FROM {duck('cites')}) c WHERE NOT EXISTS (SELECT 1 FROM {duck('bib')} b WHERE b.doc_id = c.doc_id AND regexp_matches(lower(b.raw), '\\b' || c.name || '\\b') AND contains(b.raw, c.year))")
def citation_resolution(spark: SparkSession, d: str) -> DataFrame:
    return R.unresolved_citations(projection(spark, d, "cites"), projection(spark, d, "bib"))


@add("uncited_references", f"SELECT doc_id, entry_no FROM (SELECT doc_id, entry_no, lower(regexp_extract(raw, '\\] ([A-Za-z0-9]+),', 1)) AS name, regexp_extract(raw, ' ([0-9]{{4}})\\.', 1) AS year FROM {duck('bib')}) b WHERE NOT EXISTS (SELECT 1 FROM {duck('cites')} c WHERE c.doc_id = b.doc_id AND lower(regexp_extract(c.text, '([A-Z][A-Za-z]*[0-9]*) et al', 1)) = b.name AND regexp_extract(c.text, '\\(([0-9]{{4}})\\)', 1) = b.year)")
def uncited_references(spark: SparkSession, d: str) -> DataFrame:
    return R.uncited_entries(projection(spark, d, "cites"), projection(spark, d, "bib"))


@add("venue_tags", rf"SELECT entry_no, array_to_string(list_filter([CASE WHEN regexp_matches(lower(raw), '\bfindings\b') THEN 'findings' END, CASE WHEN regexp_matches(lower(raw), '\bworkshops?\b') THEN 'workshop' END, CASE WHEN regexp_matches(lower(raw), '\bemnlp\b') THEN 'emnlp' END, CASE WHEN regexp_matches(lower(raw), '\bacl\b') THEN 'acl' END], lambda x: x IS NOT NULL), ',') AS tags FROM {duck('bib')}")
def venue_tags(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("raw")
    tags = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in (("findings", r"\bfindings\b"), ("workshop", r"\bworkshops?\b"), ("emnlp", r"\bemnlp\b"), ("acl", r"\bacl\b"))]))
    return projection(spark, d, "bib").select("entry_no", F.array_join(tags, ",").alias("tags"))


@add("segmented_entries", "SELECT doc_id, entry_no, entry_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry_no, entry_id) AS n FROM " + BIB)
def segmented_entries(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("entry_no", "entry_id")
    return _bib(spark, d).select("doc_id", "entry_no", "entry_id", F.row_number().over(w).cast("bigint").alias("n"))


@add("author_json", "SELECT id, len(a) AS n, a[1] AS first FROM (SELECT id, from_json(authors, '[\"VARCHAR\"]') AS a FROM papers)")
def author_json(spark: SparkSession, d: str) -> DataFrame:
    a = F.from_json("authors", "array<string>")
    return table(spark, d, "papers").select("id", F.size(a).cast("bigint").alias("n"), a[0].alias("first"))


@add("exact_key_join", f"SELECT p.id, r.record_id FROM papers p JOIN {REC} r ON replace({duck_title('p.title')}, ' ', '') = replace({duck_title('r.title')}, ' ', '') AND p.year = r.year WHERE length(replace({duck_title('p.title')}, ' ', '')) >= 12")
def exact_key_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select("id", "year", C.compact_title(F.col("title")).alias("k")).filter(F.length("k") >= 12)
    r = _records(spark, d).select("record_id", "year", C.compact_title(F.col("title")).alias("k"))
    return p.join(r, ["k", "year"]).select("id", "record_id")
