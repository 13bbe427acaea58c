"""Scalar functions as column expressions (JVM side, no Python).

Each takes and returns columns; SQL null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåāăąèéêëēėęěìíîïīįòóôõöøōőùúûüūůűųụýÿçćčñńňßśšžźżłďťř"
_PLAIN = "aaaaaaaaaeeeeeeeeiiiiiioooooooouuuuuuuuuyycccnnnsssszzzldtr"

# Words that a title's key leaves out.
TITLE_STOPWORDS = ["a", "an", "the", "of", "for", "and", "in", "on", "to", "with", "via", "by"]


def normalised_title(title: Column) -> Column:
    """Lower case without accents and punctuation, single spaces."""
    t = F.translate(F.lower(title), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def compact_title(title: Column) -> Column:
    """The letters and digits of the normalised title."""
    return F.regexp_replace(normalised_title(title), " ", "")


def title_key(title: Column) -> Column:
    """The normalised title without stop words, in order."""
    kept = F.filter(F.split(normalised_title(title), " "), lambda w: ~w.isin(TITLE_STOPWORDS))
    return F.array_join(kept, " ")


def token_similarity(a: Column, b: Column) -> Column:
    """Half Jaccard, half containment of the distinct title words."""
    x, y = (F.array_distinct(F.filter(F.split(normalised_title(t), " "), lambda w: ~w.isin(TITLE_STOPWORDS) & (w != ""))) for t in (a, b))
    return word_similarity(x, y)


def word_similarity(x: Column, y: Column) -> Column:
    """Half Jaccard, half containment of two lists of distinct words."""
    common = F.size(F.array_intersect(x, y))
    least, union = F.least(F.size(x), F.size(y)), F.size(F.array_union(x, y))
    return F.when(least > 0, 0.5 * common / union + 0.5 * common / least).otherwise(0.0)


def normalised_doi(doi: Column) -> Column:
    """Lower case without resolver prefix and end marks; null if it is no DOI."""
    t = F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    t = F.lower(F.regexp_replace(t, r"[.,;)\]}]+$", ""))
    return F.when(t.startswith("10.") & t.contains("/"), t)


def found_doi(text: Column) -> Column:
    """The first DOI printed in a text."""
    return normalised_doi(F.nullif(F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1), F.lit("")))


def found_arxiv(text: Column) -> Column:
    """The first arXiv id printed in a text, without its version."""
    return F.nullif(F.regexp_extract(text, r"(?i)arxiv[:\s]*([0-9]{4}\.[0-9]{4,5})", 1), F.lit(""))


def found_year(text: Column) -> Column:
    """The least year printed in a text."""
    return F.array_min(F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int")))


def page_range(pages: Column) -> tuple[Column, Column]:
    """First and last page; a shortened last page is completed, leading zeros go."""
    rx = r"^\s*([0-9]+)(?:\s*[-‐‑‒–—−]+\s*([0-9]+))?"
    first, last = F.regexp_extract(pages, rx, 1), F.regexp_extract(pages, rx, 2)
    short = (F.length(last) > 0) & (F.length(last) < F.length(first)) & (last.try_cast("bigint") < first.try_cast("bigint"))
    full = F.when(short, F.concat(first.substr(F.lit(1), F.length(first) - F.length(last)), last)).otherwise(last)
    strip = lambda c: F.when(F.length(c) > 0, F.coalesce(F.nullif(F.regexp_replace(c, "^0+", ""), F.lit("")), F.lit("0")))
    return strip(first), strip(full)


def printed_pages(raw: Column) -> Column:
    """The page range that a citation prints, labelled or after volume and issue."""
    labelled = F.regexp_extract(raw, r"(?i)(?:pages|pp\.?)\s*([0-9]+\s*[-–—]+\s*[0-9]+)", 1)
    journal = F.regexp_extract(raw, r"[0-9]+\([0-9]+\)\s*:\s*([0-9]+\s*[-–—]+\s*[0-9]+)", 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(journal, F.lit("")))


def normalised_url(url: Column) -> Column:
    """A URL repaired of spaces and a broken scheme; null without a dotted host."""
    t = F.regexp_replace(F.trim(url), r"[.,;:)\]}'\"]+$", "")
    t = F.regexp_replace(t, r"(?i)^h\s*t\s*t\s*p(s?)\s*:\s*/\s*/\s*", r"http$1://")
    t = F.regexp_replace(t, r"\s+", "")
    t = F.when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)
    return F.when(t.rlike(r"(?i)^https?://[^/\s]*[^/\s.]\.[^/\s.][^/\s]*"), t)


# Beginnings of preprint servers' DOIs, and what names them as venues.
PREPRINT_DOIS = ["10.48550/", "10.1101/", "10.2139/ssrn", "10.31219/", "10.20944/preprints", "10.21203/rs.", "10.36227/techrxiv", "10.26434/chemrxiv"]
PREPRINT_VENUES = r"(?i)\b(arxiv|corr|ssrn|preprint)\b|biorxiv|medrxiv|techrxiv|chemrxiv|research square|submitted to|not accepted"


def is_preprint(preprint: Column, doi: Column, venue: Column) -> Column:
    """What the record says, else whether its DOI or venue is a preprint server's."""
    by_doi = F.coalesce(F.lower(doi).rlike("^(" + "|".join(p.replace(".", r"\.") for p in PREPRINT_DOIS) + ")"), F.lit(False))
    by_venue = F.coalesce(venue.rlike(PREPRINT_VENUES), F.lit(False))
    return F.coalesce(preprint, by_doi | by_venue)


# Kinds of cited things, in order of precedence.
HOST_KINDS = [
    ("github.com", "software"), ("gitlab.com", "software"), ("bitbucket.org", "software"), ("pypi.org", "software"), ("huggingface.co", "model"),
    ("kaggle.com", "model"), ("zenodo.org", "model"), ("arxiv.org", "preprint"), ("aclanthology.org", "paper"), ("openreview.net", "paper"),
    ("rfc-editor.org", "standard"), ("ietf.org", "standard"), ("iso.org", "standard"), ("nist.gov", "standard"),
]
WORD_KINDS = [
    ("thesis", ["phd thesis", "ph.d. thesis", "master's thesis", "masters thesis", "dissertation"]),
    ("paper", ["in proceedings", "proceedings of", "journal of", "transactions on", "conference on", "in advances in", "acl", "emnlp", "naacl", "neurips", "icml", "iclr", "aaai", "cvpr", "volume", "pages ", "pp."]),
    ("software", ["github", "gitlab", "repository", "software", "python package", "library, version"]),
    ("blog", ["blog", "news", "announc", "introducing ", "release notes", "press release", "retrieved from", "accessed ", "[online]", "web page", "website"]),
    ("book", ["press,", "publishers", "isbn", "edition,", "chapter "]),
]


def reference_kind(raw: Column, venue: Column, doi: Column, arxiv: Column, url: Column) -> Column:
    """What a citation cites; identifiers before hosts before words."""
    text = F.lower(F.concat_ws(" ", raw, venue))
    href = F.lower(F.coalesce(url, F.lit("")))
    out = F.when(doi.isNotNull(), "paper").when(arxiv.isNotNull(), "preprint")
    for host, kind in HOST_KINDS:
        out = out.when(href.contains(host), kind)
    for kind, hints in WORD_KINDS:
        test = F.lit(False)
        for h in hints:
            test = test | text.contains(h)
        out = out.when(test, kind)
    return out.when(href != "", "web").otherwise("unknown")


def surname(name: Column) -> Column:
    """The last name of "Doe, Jane" and "Jane Doe"."""
    words = F.filter(F.split(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}\s]+", " ")), r"\s+"), lambda w: F.length(w) > 1)
    return F.when(name.contains(","), normalised_title(F.split(name, ",")[0])).otherwise(normalised_title(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))))


def surnames(authors: Column) -> Column:
    """The distinct surnames of a list of names."""
    return F.array_distinct(F.filter(F.transform(authors, surname), lambda s: s != ""))


def author_overlap(a: Column, b: Column) -> Column:
    """Share of the shorter list whose surnames stand in the other; null if either is unknown."""
    return name_overlap(surnames(a), surnames(b))


def name_overlap(x: Column, y: Column) -> Column:
    """Share of the shorter list of distinct surnames that stand in the other; null if either is unknown."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least)


def shortened(text: Column, most: int = 200) -> Column:
    """White space collapsed, cut at ``most`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def run_id(path: Column) -> Column:
    """The first eight hex digits of a path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 8)


def cache_key(text: Column, version: int = 12) -> Column:
    """A versioned key of a text that ignores case and white space."""
    return F.concat(F.lit(f"v{version}:"), F.substring(F.sha1(F.regexp_replace(F.lower(text), r"\s+", "")), 1, 24))
