"""Reference resolution: candidates, judging, best candidate, status, alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.session import dropped, landed

# Title and author thresholds of a judgement, years of slack.
ACCEPT, REVIEW, AUTHOR, ALONE, SLACK = 0.90, 0.72, 0.34, 0.95, 2
#: Word similarity from which titles are compared; letters of a start that is enough besides.
WORDS, BLOCK = 0.5, 24
#: Words of a title up to which it is met by pairs of its words; a longer one is met by each word.
PAIRED = 24


def dedupe_groups(bib: DataFrame) -> DataFrame:
    """(key, n, first): entries of one DOI, arXiv id, title key or text, in that order of precedence."""
    key = C.title_key(F.coalesce("title", F.lit("")))
    k = (
        F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), F.lower("doi")))
        .when(F.col("arxiv_id").isNotNull(), F.concat(F.lit("arxiv:"), "arxiv_id"))
        .when(key != "", F.concat(F.lit("title:"), key))
        .otherwise(F.concat(F.lit("raw:"), F.md5(F.coalesce("raw", F.lit("")))))
    )
    return bib.groupBy(k.alias("key")).agg(F.count("*").alias("n"), F.min("entry_id").alias("first"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_keys(w: np.ndarray, share: float, short: bool) -> Iterator[tuple[int, np.ndarray, int]]:
    """(words in the key, hashes by title, place of the key's last word) of titles with equally many words, the rows of ``w``.

    Of c >= ceil(share l) common words the two rarest stand among the first l - c + 1 and l - c + 2 of the ``short`` title,
    and anywhere in the other one; where one is enough, one makes the key. A title of more than ``PAIRED`` words
    has no pairs of them, and meets every first word."""
    l = w.shape[1]
    h = _mixed(w)
    single = lambda kind, i: _mixed(h[:, i] + np.uint64(kind))
    c = math.ceil(share * l)
    if l > PAIRED or short:
        for i in range(l - c + 1 if short else l):
            yield 3, single(3, i), i
    if l > PAIRED:
        return
    if not short or c == 1:
        for i in range(l):
            yield 1, single(1, i), i
    if not short or c > 1:
        for i in range(l - c + 1 if short else l):
            for j in range(i + 1, min(l, l - c + 2) if short else l):
                yield 2, _mixed(h[:, i] * np.uint64(0x9E3779B97F4A7C15) + h[:, j]), j


def _word_pairs(e: DataFrame, r: DataFrame, least: float = WORDS) -> DataFrame:
    """(e_i, r_i) of all titles (i, w) whose word similarity is at least ``least``, none left out: c common words of
    titles of l <= m words score c / 2 (1 / (l + m - c) + 1 / l), most for l = m, so that c >= x l for the x at
    which that is ``least``. Titles meet by their two rarest common words (one if one is enough); words that
    stand in one of the titles alone, as the bits of 64 tell, leave few pairs whose words are compared."""
    share = (3 + 2 * least - math.sqrt((3 + 2 * least) ** 2 - 16 * least)) / 2 - 1e-9
    n = e.select(F.explode("w").alias("x")).unionAll(r.select(F.explode("w").alias("x"))).groupBy("x").agg(F.count("*").alias("n"))

    def ranked(df: DataFrame) -> DataFrame:
        x = df.select("i", F.explode("w").alias("x")).join(n, "x").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("w"))
        return landed(x.select("i", F.transform("w.x", lambda x: F.xxhash64(x)).alias("w")), "title-words")

    def keys(df: DataFrame, short: bool, side: str) -> DataFrame:
        def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                sizes = pdf["w"].map(len).to_numpy()
                ids = pdf["i"].to_numpy(np.int64)
                for l in np.unique(sizes):
                    at = np.flatnonzero(sizes == l)
                    w = np.stack(pdf["w"].to_numpy()[at]).astype(np.int64).view(np.uint64)
                    bits = np.bitwise_or.reduce(np.uint64(1) << (_mixed(w) & np.uint64(63)), 1)
                    made = list(_word_keys(w, share, short))
                    places = np.repeat(np.array([int(l) << 32 | kind << 28 | j for kind, _, j in made], np.int64), len(at))
                    yield pd.DataFrame({"h": (np.concatenate([h for _, h, _ in made]) >> np.uint64(32)).astype(np.uint32).view(np.int32), "i": np.tile(ids[at], len(made)), "at": places, "bits": np.tile(bits.view(np.int64), len(made))})

        return df.mapInPandas(op, "h int, i long, at long, bits long").select("h", F.col("i").alias(f"{side}_i"), F.col("at").alias(f"{side}_at"), F.col("bits").alias(f"{side}_bits"))

    def met(short: DataFrame, long: DataFrame, more: int) -> DataFrame:
        of = lambda side: (F.shiftright(f"{side}_at", 32), F.col(f"{side}_at").bitwiseAND((1 << 28) - 1))
        kind = F.shiftright("s_at", 28).bitwiseAND(15)
        (s_l, s_j), (g_l, g_j) = of("s"), of("g")
        score = lambda c: 0.5 * c / (s_l + g_l - c) + 0.5 * c / s_l
        alone = lambda x, y: F.bit_count(F.col(f"{x}_bits").bitwiseAND(F.bitwise_not(f"{y}_bits")))
        behind = F.least(s_l - s_j, g_l - g_j) - 1 + F.when(kind == 2, 2).otherwise(1)
        common = F.least(behind, s_l - alone("s", "g"), g_l - alone("g", "s"))
        both = keys(short, True, "s").hint("merge").join(keys(long, False, "g"), "h")
        return both.filter((s_l + more <= g_l) & (score(common) >= least - 1e-9)).select("s_i", "g_i")

    ew, rw = ranked(e), ranked(r)
    pairs = met(ew, rw, 0).select(F.col("s_i").alias("e_i"), F.col("g_i").alias("r_i")).unionAll(met(rw, ew, 1).select(F.col("g_i").alias("e_i"), F.col("s_i").alias("r_i"))).distinct()
    pairs = dropped(landed(pairs, "word-pairs"))
    return dropped(landed(_scored_titles(pairs, e, r).filter(F.col("score") >= least - 1e-9).select("e_i", "r_i"), "word-pairs"))


def _scored_titles(pairs: DataFrame, e: DataFrame, r: DataFrame) -> DataFrame:
    """The pairs (e_i, r_i) of titles with their word similarity."""
    both = pairs.join(e.select(F.col("i").alias("e_i"), F.col("w").alias("e_w")), "e_i").join(r.select(F.col("i").alias("r_i"), F.col("w").alias("r_w")), "r_i")
    return both.select("e_i", "r_i", C.word_similarity(F.col("e_w"), F.col("r_w")).alias("score"))


def _change_pairs(e: DataFrame, r: DataFrame) -> DataFrame:
    """(e_i, r_i) of all titles (i, k) whose compact forms are equal or one letter apart: one change
    leaves the first or the last half of the shorter form as it is."""

    def keys(df: DataFrame, side: str) -> DataFrame:
        size = F.length("k")
        x = df.select(F.col("i").alias(f"{side}_i"), F.col("k").alias(f"{side}_k"), "k", F.explode(F.array(size, size - 1)).alias("n")).withColumn("h", F.floor(F.col("n") / 2).cast("int"))
        half = F.array(F.struct(F.lit(0).alias("end"), F.expr("left(k, h)").alias("part")), F.struct(F.lit(1).alias("end"), F.expr("right(k, n - h)").alias("part")))
        return x.select(f"{side}_i", f"{side}_k", "n", F.explode(half).alias("at")).select(f"{side}_i", f"{side}_k", "n", "at.*")

    return keys(e, "e").join(keys(r, "r"), ["n", "end", "part"]).filter(F.levenshtein("e_k", "r_k", 1) >= 0).select("e_i", "r_i")


class Candidates:
    """Entries and records to compare: word similarity of the titles of at least WORDS, compact titles at most
    one change apart or of one long start, or one DOI. Word similarity is 0 for titles without Latin letters
    or digits: these meet by DOI alone. Titles are matched, by numbers, and scored once however many rows have them.

    With ``least`` only the pairs of that word similarity are asked for, however they come to be candidates."""

    def __init__(self, bib: DataFrame, records: DataFrame, least: float | None = None) -> None:
        title = C.normalised_title(F.col("title")).alias("t")
        whole = lambda df, key, doi: landed(df.filter("title IS NOT NULL").select(key, "title", "authors", "year", C.surnames(F.col("authors")).alias("names"), title, doi.alias("dois")), key)
        e = whole(bib, "entry_id", F.array(C.normalised_doi(F.col("doi"))))
        r = whole(records, "record_id", F.array(C.normalised_doi(F.col("doi")), C.normalised_doi(F.col("published_doi"))))

        def titles(df: DataFrame) -> DataFrame:
            words = F.array_distinct(F.filter(F.split(C.title_key(F.col("t")), " "), lambda w: w != ""))
            return landed(df.filter("t <> ''").select("t").distinct().select(F.monotonically_increasing_id().alias("i"), "t", words.alias("w"), F.regexp_replace("t", " ", "").alias("k")), "titles")

        self.et, self.rt = titles(e), titles(r)
        self.e, self.r = e.join(self.et.select("t", F.col("i").alias("e_i")), "t", "left"), r.join(self.rt.select("t", F.col("i").alias("r_i")), "t", "left")
        self.by_doi: DataFrame | None = None
        pairs = _word_pairs(self.et, self.rt, least or WORDS)
        if least is None:
            start = lambda df, side: df.filter(F.length("k") >= BLOCK).select(F.col("i").alias(f"{side}_i"), F.substring("k", 1, BLOCK).alias("b"))
            pairs = pairs.unionAll(_change_pairs(self.et, self.rt)).unionAll(start(self.et, "e").join(start(self.rt, "r"), "b").select("e_i", "r_i")).distinct()
            pairs = dropped(landed(pairs, "candidates"))
            self.pairs = dropped(landed(_scored_titles(pairs, self.et, self.rt), "title-pairs"))
            dois = lambda df, *c: df.select(*c, F.explode("dois").alias("doi"))
            both = dois(self.e, "entry_id", "e_i", F.col("t").alias("e_t")).join(dois(self.r, "record_id", "r_i", F.col("t").alias("r_t")), "doi")
            # one DOI, and titles that are no candidates
            self.by_doi = both.drop("doi").distinct().join(self.pairs, ["e_i", "r_i"], "left_anti")
        else:
            self.pairs = dropped(landed(_scored_titles(pairs, self.et, self.rt), "title-pairs"))

    def rows(self, *fields: str) -> DataFrame:
        """(entry_id, record_id, score) of the pairs with ``fields`` of both rows."""
        of = lambda df, key, side: df.select(key, f"{side}_i", *[F.col(c).alias(f"{side}_{c}") for c in fields])
        e, r = of(self.e, "entry_id", "e"), of(self.r, "record_id", "r")
        out = self.pairs.join(e, "e_i").join(r, "r_i").drop("e_i", "r_i")
        if self.by_doi is not None:
            score = C.token_similarity(F.col("e_t"), F.col("r_t")).alias("score")
            doi = self.by_doi.select("entry_id", "record_id", score)
            out = out.unionByName(doi.join(e.drop("e_i"), "entry_id").join(r.drop("r_i"), "record_id"))
        return out

    def titles(self) -> DataFrame:
        """(left_title, right_title) of the pairs' normalised titles."""
        of = lambda df, side, name: df.select(F.col("i").alias(f"{side}_i"), F.col("t").alias(name))
        out = self.pairs.join(of(self.et, "e", "left_title"), "e_i").join(of(self.rt, "r", "right_title"), "r_i").select("left_title", "right_title")
        return out if self.by_doi is None else out.unionAll(self.by_doi.select("e_t", "r_t").distinct())


def candidate_pairs(bib: DataFrame, records: DataFrame, least: float | None = None) -> DataFrame:
    """(entry_id, record_id) of the candidates, with the titles, authors and years of both rows."""
    return Candidates(bib, records, least).rows("title", "authors", "year").drop("score")


def scored_candidates(bib: DataFrame, records: DataFrame, least: float | None = None) -> DataFrame:
    """(entry_id, record_id, e_year, r_year, score, authors): word similarity of the titles and author overlap (null: unknown)."""
    p = Candidates(bib, records, least).rows("names", "year")
    return p.select("entry_id", "record_id", "e_year", "r_year", "score", C.name_overlap(F.col("e_names"), F.col("r_names")).alias("authors"))


def judged(scored: DataFrame) -> DataFrame:
    """(entry_id, record_id, score, author_score, outcome): accept, review or reject; -1 for unknown authors."""
    s, a = F.col("score"), F.col("authors")
    outcome = (
        F.when(s < REVIEW, "reject")
        .when(F.abs(F.col("e_year") - F.col("r_year")) > SLACK, "review")
        .when(s >= ACCEPT, F.when(a < AUTHOR, "review").when(a.isNull() & (s < ALONE), "review").otherwise("accept"))
        .otherwise("review")
    )
    return scored.select("entry_id", "record_id", F.round(s, 6).alias("score"), F.round(F.coalesce(a, F.lit(-1.0)), 6).alias("author_score"), outcome.alias("outcome"))


def best(candidates: DataFrame) -> DataFrame:
    """The best candidate of each entry: outcome, then score, then authors, then the smaller record."""
    rank = F.when(F.col("outcome") == "accept", 0).when(F.col("outcome") == "review", 1).otherwise(2)
    order = Window.partitionBy("entry_id").orderBy(rank, F.desc("score"), F.desc("author_score"), "record_id")
    return candidates.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def best_candidates(bib: DataFrame, records: DataFrame) -> DataFrame:
    """The best candidate of each entry, rejected ones included. An entry with candidates of the review threshold has
    its best among these; candidates below it are asked for the other entries alone."""
    kept = landed(best(judged(scored_candidates(bib, records, REVIEW))).filter("outcome <> 'reject'"), "best-kept")
    rest = bib.join(kept.select("entry_id"), "entry_id", "left_anti")
    return kept.unionByName(best(judged(scored_candidates(rest, records))))


def statuses(bib: DataFrame, found: DataFrame) -> DataFrame:
    """(entry_id, status) down the ladder from unparsed to not found."""
    at = bib.join(found, "entry_id", "left")
    status = (
        F.when(F.col("title").isNull() & F.col("doi").isNull() & F.col("arxiv_id").isNull(), "unparsed")
        .when(F.col("outcome") == "accept", "verified")
        .when((F.col("outcome") == "review") & (F.col("author_score") >= 0) & (F.col("author_score") < AUTHOR), "author_mismatch")
        .when(F.col("outcome") == "review", "unconfirmed")
        .when(F.col("doi").isNotNull(), "unindexed")
        .otherwise("not_found")
    )
    return at.select("entry_id", status.alias("status"))


def similarity(a: str, b: str) -> float:
    """Similarity of two normalised titles: equal 1, else the larger of the sequence
    ratio and half Jaccard plus half containment of their words."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    match = SequenceMatcher(None, a, b)
    x, y = ({w for w in t.split() if w not in C.TITLE_STOPWORDS} for t in (a, b))
    if not x or not y:
        return match.ratio()
    common = len(x & y)
    own = 0.5 * common / len(x | y) + 0.5 * common / min(len(x), len(y))
    # a bound of the ratio tells where the words decide
    return own if match.quick_ratio() <= own else max(match.ratio(), own)


def title_similarities(bib: DataFrame, records: DataFrame) -> DataFrame:
    """(left_title, right_title, similarity) of the distinct candidate title pairs."""
    p = Candidates(bib, records).titles()
    p = p.repartition(4 * int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # heavy for its bytes

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(similarity=[round(similarity(a, b), 6) for a, b in zip(pdf["left_title"], pdf["right_title"], strict=True)])

    return p.mapInPandas(op, "left_title string, right_title string, similarity double")


def align(cited: list[str], recorded: list[str]) -> list[int]:
    """For each cited surname the place of its record, -1 for none: equal first, then
    one a start of the other, the nearest free place each time."""
    out, used = [-1] * len(cited), set()
    for test in (lambda x, y: x == y, lambda x, y: len(x) >= 4 and len(y) >= 4 and (x.startswith(y) or y.startswith(x))):
        for i, c in enumerate(cited):
            if out[i] < 0:
                free = [j for j, r in enumerate(recorded) if j not in used and test(c, r)]
                if free:
                    out[i] = min(free, key=lambda j: (abs(j - i), j))
                    used.add(out[i])
    return out


def author_alignments(bib: DataFrame, records: DataFrame) -> DataFrame:
    """(entry_id, record_id, matched, missing, swapped) of each entry's best candidate."""
    top = best(judged(scored_candidates(bib, records, REVIEW))).filter("outcome <> 'reject'").select("entry_id", "record_id")
    names = lambda df, k, n: df.select(k, F.transform("authors", C.surname).alias(n))
    both = top.join(names(bib, "entry_id", "c"), "entry_id").join(names(records, "record_id", "r"), "record_id").filter("c IS NOT NULL AND r IS NOT NULL")

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for e, r, c, rec in zip(pdf["entry_id"], pdf["record_id"], pdf["c"], pdf["r"], strict=True):
                got = align([x for x in c if x], [x for x in rec if x])
                hit = [j for j in got if j >= 0]
                rows.append((e, r, len(hit), len(got) - len(hit), sum(a > b for a, b in zip(hit, hit[1:], strict=False))))
            yield pd.DataFrame(rows, columns=["entry_id", "record_id", "matched", "missing", "swapped"])

    return both.select("entry_id", "record_id", "c", "r").mapInPandas(op, "entry_id string, record_id string, matched int, missing int, swapped int")


def citations(text: DataFrame) -> DataFrame:
    """(doc_id, name, year) of author-year citations."""
    return text.select("doc_id", F.lower(F.regexp_extract("text", r"([A-Z][A-Za-z]*[0-9]*) et al", 1)).alias("name"), F.regexp_extract("text", r"\(([0-9]{4})\)", 1).alias("year"))


def unresolved_citations(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Citations that no entry of their document answers: every word and year of an
    entry is a key, so the test is an equal anti-join."""
    words = bib.select("doc_id", "entry_no", F.explode(F.array_distinct(F.split(F.lower("raw"), r"[^a-z0-9_]+"))).alias("name"), "raw")
    keys = words.select("doc_id", "name", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"(?=([0-9]{4}))"), 1))).alias("year")).distinct()
    return citations(cites).distinct().join(keys, ["doc_id", "name", "year"], "left_anti")


def uncited_entries(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """(doc_id, entry_no) of the entries that no citation names."""
    b = bib.select("doc_id", "entry_no", F.lower(F.regexp_extract("raw", r"\] ([A-Za-z0-9]+),", 1)).alias("name"), F.regexp_extract("raw", r" ([0-9]{4})\.", 1).alias("year"))
    return b.join(citations(cites), ["doc_id", "name", "year"], "left_anti").select("doc_id", "entry_no")
