"""Matching entities across sources without keys (problem 5).

Sorted neighbourhood: every row has several composite sort keys (start of the
title, end of the title, first author with the title's head, with the year, with
the pages).  The distinct values of a key are sorted; rows of equal values meet,
and rows of title values that stand within ``WINDOW`` places and differ by
little.  Sliding over distinct values, not over rows, keeps a hot work (a third
of all rows) from pushing its neighbours out of the window.  All rows of a value
meet; one under which more than ``BLOCK`` records stand (a stock title, a common
name and year) is dealt to several tasks.

Comparison: title, authors, year, venue and pages give weighted similarities
and their sum the confidence; what a citation lacks in fields is read from its
raw text.  Venues agree by their words, short forms of these, or letters that
start them.  Records are compared with one another and joined into works in the
same search that compares citations with them.

Assignment: a citation goes to the work with the most confidence (ties: the
smaller work key), if that is at least ``ACCEPT``.  A bibliography lists a work
once, so where entries of one document want the same work and one of them has
another, entries and works are assigned one to one so that the total confidence
is greatest; an entry that gets no work that way keeps its best one (a document
may list a work twice).  An entry is matched with every record of its work.

Defined results: a row whose key is null is left out; a row without title needs
its raw text; null authors, years, venues and pages neither help nor
contradict; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.names import distance
from quire.llm.names_text import compact, folded, words
from quire.session import landed

WINDOW, NEAR, ACCEPT = 4, 2, 0.6
#: Records of one key value that one task has at most, more or less; all of them meet all rows of the value.
BLOCK = 64
# The weights of title, authors, year, venue and pages in a confidence.
WEIGHTS = (0.45, 0.25, 0.1, 0.1, 0.1)
#: Letters of a title's start and end that make a sort key.
HEAD, TAIL = 36, 44
#: Letters that a title has at least to make these keys.
SHORT = 8

#: ``traits``: titles, name parts, years, venues, pages, preprint, DOI and first names of a row as one text.
#: ``hs``: the hashes of its sort keys.
FEATURES = "id string, traits string, unit string, hs array<long>"
_SEP = "\x1f"
_NAMES = ["id", "traits", "unit", "hs"]
_ARROW = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]

_DIGITS = re.compile(r"\d+")
_PAGES = re.compile(r"(?<!\d)(\d{1,5})\s*[-‐‑–—]+\s*(\d{1,5})(?!\d)")
_MARK = re.compile(r"^(?:et al\.?|and others|others|al\.?)$", re.I)
# What a follow-up adds to the title of the work it follows.
_FOLLOW_UP = re.compile(r"(?:a|the)?(?:replication|reply|comment|erratum|corrigendum|survey)?(?:study)?(?:revisited|replication|inpractice|extended|extendedversion|followup|part(?:[ivx]+|\d+|one|two|three))?\Z")
# Kinds of venue by the words that name them, and words that no venue owns.
_VENUE_KINDS = {
    "conference": "c", "conf": "c", "symposium": "c", "symp": "c", "meeting": "c", "congress": "c", "workshop": "w", "wkshp": "w", "workshops": "w",
    "journal": "j", "j": "j", "transactions": "j", "trans": "j", "letters": "j", "annals": "j", "review": "j",
}
_GENERIC = {"proceedings", "proc", "of", "on", "the", "and", "in", "for", "at", "a", "annual", "international", "intl", "int", "joint", "preprint"}
_ACRONYM = re.compile(r"(?<![A-Za-z])(?=[A-Za-z]*[A-Z][A-Za-z]*[A-Z])[A-Z][A-Za-z]{1,7}(?![A-Za-z])")


@functools.lru_cache(1 << 16)
def venue_form(venue: str | None) -> str:
    """A venue as one word: its kind (c, w, j or nothing) and its own words, or ``=`` and the letters it is known by."""
    if not venue:
        return ""
    own = [w for w in words(venue) if not re.fullmatch(r"\d+(?:st|nd|rd|th)?|[ivxl]+", w)]
    kind = next((_VENUE_KINDS[w] for w in own if w in _VENUE_KINDS), "")
    named = [w for w in own if w not in _VENUE_KINDS and w not in _GENERIC]
    if not kind and len(named) == 1 and (m := _ACRONYM.search(venue)):
        return "=" + m.group().lower()
    return f"{kind}:{'-'.join(named)}" if named else ""


def _spelled(letters: str, parts: tuple[str, ...]) -> bool:
    """Whether letters are starts of words set one after another (NeurIPS: neural information processing systems)."""
    if not letters:
        return True
    for i, w in enumerate(parts):
        k = 0
        while k < len(w) and k < len(letters) and w[k] == letters[k]:
            k += 1
        for n in range(k, 0, -1):
            if _spelled(letters[n:], parts[:i] + parts[i + 1 :]):
                return True
    return False


def _same_word(a: str, b: str) -> bool:
    """Equal, short for the other (three letters or more), or long and close."""
    if a == b:
        return True
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return True
    if min(len(a), len(b)) < 7:
        return False
    g, h = _grams(a), _grams(b)
    return _near(a, b) or 2 * len(g & h) >= 0.5 * (len(g) + len(h))


@functools.lru_cache(1 << 16)
def venues_agree(a: str, b: str) -> bool:
    """Whether two venues' forms name one venue."""
    if a == b:
        return True
    if a[0] == "=" or b[0] == "=":
        if a[0] == b[0]:
            return False
        short, (kind, _, named) = (a, b.partition(":")) if a[0] == "=" else (b, a.partition(":"))
        stands_for = {"c": "conference", "w": "workshop", "j": "journal"}
        return _spelled(short[1:], (*named.split("-"), *([stands_for[kind]] if kind else [])))
    (ka, _, na), (kb, _, nb) = a.partition(":"), b.partition(":")
    if ka and kb and ka != kb:
        return False
    x, y = sorted((na.split("-"), nb.split("-")), key=len)
    return sum(any(_same_word(w, v) for v in y) for w in x) >= 0.75 * len(x)


# How a venue's full name stands in a citation's text.
_NAMED_VENUE = re.compile(r"(?:conference|conf\.|workshop|wkshp|symposium|symp\.)\s[^\d\n]*?(?=[.,;]{1,2}\s*(?:\d|\(|pages|pp|doi|$)|\s\d|$)", re.I)
_NAMED_JOURNAL = re.compile(r"\w+\s+(?:journal of|j\.\s)[^\d\n]*?(?=[.,;]{1,2}\s*(?:\d|\(|pages|pp|doi|$)|\s\d|$)", re.I)


def _raw_venues(raw: str) -> list[str]:
    """Venues that stand in a citation's text, as forms."""
    flat = re.sub(r"[-¬=]?\s*\n\s*", " ", raw)
    out = {venue_form(m.group()) for r in (_NAMED_VENUE, _NAMED_JOURNAL) for m in r.finditer(flat)}
    if not out and not raw.isupper():
        # letters that stand for themselves between two stops, a year or pages beside them
        out = {f"={m.group(1).lower()}" for m in re.finditer(r"(?:[.,;)]|\bIn|Proc\.|Wkshp|Conf\.)\s+([A-Z]{3,8})(?=[.,;]|\s+(?:19|20)\d\d)", flat)}
    return sorted(out - {""})


def _years_in(text: str) -> list[str]:
    """Numbers of a text that are years."""
    return [d for d in _DIGITS.findall(text) if len(d) == 4 and d[:2] in ("19", "20")]


@functools.lru_cache(1 << 17)
def _name_tokens(name: str) -> tuple[str, ...]:
    if _MARK.match(name.strip()):
        return ()
    parts = [p for p in (w.rstrip("0123456789") for w in words(name.replace("-", ""))) if p]
    return tuple([p for p in parts if len(p) >= 3] or parts)


def author_tokens(authors) -> list[str]:
    """Distinct parts of names, in order; initials and short parts only of names that have no longer ones."""
    return list(dict.fromkeys(w for a in _listed(authors) if a for w in _name_tokens(a)))


def _listed(authors) -> list[str]:
    """A list of names, or its text with separators between."""
    return authors.split(_SEP) if isinstance(authors, str) else list(authors) if authors is not None else []


def _title_of(raw: str, known: str = "", names: list[str] | None = None) -> str:
    """The likeliest title in a citation's text: the part that holds the known
    start of it, else the longest part that is no venue and no list of names."""
    flat = re.sub(r"(\w)[-¬=]\s*\n\s*", r"\1", raw).replace("\n", " ")
    parts = re.split(r"[“”\"]|(?<=[^\W\d_]{2})\.\s+|;\s+|\)\.?\s+|,\s+(?=In |\d{4})", flat)
    parts = [p for p in parts if not re.match(r"\s*(?:in\s+)?(?:proceedings|proc\.|conference|conf\.|workshop|wkshp|pages|pp|doi|\w+ journal of|\w+ j\.)", p, re.I)]
    parts = [re.sub(r"^\W*(?:(?:19|20)\d\d\W+|\[?\d{1,3}\]\s*)?", "", p) for p in parts]
    if known:
        tail = known[-12:].lower()
        return next((p for p in parts if tail in p.lower()), "")
    seen = set(names or [])
    parts = [p for p in parts if not seen or sum(w in seen for w in words(p)) < 2]
    return max(parts, key=lambda p: len(p) - 25 * p.count(",") - 25 * len(re.findall(r"\s\w\.\s", p)), default="")


def _first(authors) -> str:
    """The longest part of the first name, mostly a surname."""
    toks = next((t for a in _listed(authors) if a and (t := _name_tokens(a))), ())
    return max(toks, key=lambda w: (len(w), w), default="")


def _hashes(key: str) -> int:
    """A key's 64-bit hash, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(key, 42)
    return h - (1 << 64) if h >> 63 else h


def keys_of(text: str) -> list[str]:
    """A row's sort keys, each under its letter: start and end of the title, first name with
    the title's head, with year and the title's first letters, with pages."""
    ts, _, years, _, pages, _, _, firsts = text.split("\t")
    ts = ts.split()
    titles = [t for t in ts if t[0] != ":"]
    out = {k for t in titles if len(t) >= SHORT for k in ("a" + t[:HEAD], "b" + t[: -TAIL - 1 : -1])}
    if firsts:
        heads, years, pages = [t[1:] for t in ts if t[0] == ":"] or titles, years.split(), pages.split()
        for name in firsts.split():
            out.update([f"e{name} {head[:24]}" for head in heads])
            out.update([f"c{name} {y} {t[:3]}" for y in years for t in titles or [""]])
            out.update([f"d{p} {name[:2]}" for p in pages])
    return sorted(out)


def _hashes(text: str) -> list[int]:
    """The sort keys' 64-bit hashes, as Spark's xxhash64 gives them."""
    return [h - (1 << 64) if (h := xxhash.xxh64_intdigest(k, 42)) >> 63 else h for k in keys_of(text)]


def _slid(df: DataFrame):
    """The values (k) of the title keys of rows with traits, which are slid over."""
    titles = F.filter(F.split(F.split("traits", "\t")[0], " "), lambda t: (F.length(t) >= SHORT) & ~t.startswith(":"))
    both = F.transform(titles, lambda t: F.array(F.concat(F.lit("a"), F.substring(t, 1, HEAD)), F.concat(F.lit("b"), F.substring(F.reverse(t), 1, TAIL))))
    return df.select(F.explode(F.flatten(both)).alias("k"))


def _head(title: str | None) -> str:
    """What stands before the title's colon; nothing if there is none."""
    return compact(title.partition(":")[0]) if title and ":" in title else ""


def _is_cut(title: str, flat: str) -> bool:
    """Whether the printed title goes on after a colon where the field's title ends."""
    at = flat.lower().find(title[-12:].lower())
    return at >= 0 and flat[at + len(title[-12:]) :][:1] == ":"


def _arrow(rows: list[list]) -> pa.RecordBatch:
    """A batch of features from its columns."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _ARROW, strict=True)], _NAMES)


def entry_features(df: DataFrame) -> DataFrame:
    """Features of citations (entry_id, raw, title, authors, year, venue, pages, doi)."""

    def read(raw, title, authors, year, venue, pages, doi) -> str:
        raw = raw or ""
        flat = raw.replace("-\n", "").replace("\n", " ")
        toks = author_tokens(authors)
        if not title or _is_cut(title, flat):
            title = _title_of(raw, title or "", toks) or title
        c, h = compact(title), _head(title)
        years = _years_in(flat)
        if year is not None and years != [str(year)]:
            years = list(dict.fromkeys([str(year), *years]))
        found = _PAGES.findall(pages or re.sub(r"-\s*\n\s*", "-", raw))
        ps = list(dict.fromkeys("-".join(m) for m in found)) if found else found
        vs = [v] if (v := venue_form(venue)) else _raw_venues(raw)
        return traits([c, *([f":{h}"] if h else [])] if c else [], toks, years, vs, ps, False, (doi or "").lower(), _first(authors))

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keys, *fields = [c.to_pylist() for c in batch.columns]
            texts = [read(*x) for x in zip(*fields, strict=True)]
            yield _arrow([keys, texts, [""] * len(keys), [_hashes(t) for t in texts]])

    picked = df.filter("entry_id IS NOT NULL").select("entry_id", "raw", "title", F.array_join("authors", _SEP).alias("authors"), "year", "venue", "pages", "doi")
    return picked.mapInArrow(op, FEATURES)


def record_features(df: DataFrame) -> DataFrame:
    """Features of bibliographic records."""

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows: list[tuple[str, str, str]] = []
            for key, title, authors, year, years, venue, pages, doi, preprint, ref, pdoi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                c, h = compact(title), _head(title)
                toks = author_tokens(authors)
                ys = [str(year)] if year is not None else []
                ys = list(dict.fromkeys(ys + (years or "").split() + _years_in(ref or "")))
                pre = bool(preprint) or "preprint" in (venue or "").lower()
                vs = sorted({venue_form(ref), "" if pre else venue_form(venue)} - {""})
                ps = ["-".join(m) for m in _PAGES.findall(pages or "")]
                d, first = (doi or pdoi or "").lower(), _first(authors)
                unit = f"doi {d}" if d else f"work {c} {first} {ys[0]}" if len(c) >= 12 and first and ys else f"id {key}"
                rows.append((key, traits([c, *([f":{h}"] if h else [])] if c else [], toks, ys, vs, ps, pre, d, first), unit))
            yield _arrow([*([x[k] for x in rows] for k in range(3)), [[]] * len(rows)])

    picked = df.filter("record_id IS NOT NULL").select("record_id", "title", F.array_join("authors", _SEP).alias("authors"), "year", F.array_join("years", " ").alias("years"), "venue", "pages", "doi", "preprint", "journal_ref", "published_doi")
    return picked.mapInArrow(op, FEATURES)


def traits(titles: list[str], toks: list[str], years: list[str], venues: list[str], pages: list[str], preprint: bool, doi: str, first: str) -> str:
    """The traits of a row as one text."""
    return "\t".join((" ".join(titles), " ".join(toks), " ".join(years), " ".join(venues), " ".join(pages), "p" if preprint else "", doi, first))


def merged(features: DataFrame) -> DataFrame:
    """(id, traits, unit, hs) for each unit of records: the traits of all its rows together, and their sort keys."""

    def both(sets: list[str]) -> str:
        rows = [t.split("\t") for t in sets]
        cols = [" ".join(dict.fromkeys(w for r in rows for w in r[k].split(" ") if w)) for k in (0, 1, 2, 3, 4, 7)]
        return "\t".join([*cols[:5], "p" if all(r[5] for r in rows) else "", max(r[6] for r in rows), cols[5]])

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            units, sets = (c.to_pylist() for c in batch.columns)
            texts = [both(t.split("\n")) if "\n" in t else t for t in sets]
            yield _arrow([units, texts, units, [_hashes(t) for t in texts]])

    groups = features.groupBy("unit").agg(F.array_join(F.sort_array(F.collect_set("traits")), "\n").alias("sets"))
    return groups.mapInArrow(op, FEATURES)


@functools.lru_cache(1 << 14)
def _grams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _near(a: str, b: str) -> bool:
    """Equal but for one change, swap, missing or added letter (or a start of five letters)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return len(a) >= 4 and len(b) >= 4 and (a.startswith(b) or b.startswith(a))
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return (len(x) <= 1 and len(y) <= 1) or (len(x) == 2 and x == y[::-1])


def _replaced(a: str, b: str) -> int:
    """Letters that one stretch of change takes from either title at least (a replaced word has four or more)."""
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return min(len(a), len(b)) - i - j


def authors_agree(x: list[str], y: list[str]) -> float | None:
    """Share of the shorter list of name parts found in the other; None if either is unknown."""
    if not len(x) or not len(y):
        return None
    if len(x) > len(y):
        x, y = y, x
    ys = set(y)
    return sum(w in ys or any(_near(w, v) for v in y if v[0] == w[0] or v[-1] == w[-1]) for w in x) / len(x)


def _titles(ta: str, tb: str) -> tuple[float, bool]:
    """(similarity, partial) of two titles."""
    if ta == tb:
        return 1.0, False
    if min(len(ta), len(tb)) >= 3 and (ta.startswith(tb) or tb.startswith(ta)):
        short, long = sorted((ta, tb), key=len)
        return (0.0, False) if _FOLLOW_UP.match(long[len(short) :]) else (0.9, True)
    g, h = _grams(ta), _grams(tb)
    t = 2 * len(g & h) / (len(g) + len(h)) if g and h else 0.0
    return t, t < 0.93


def _pages_agree(pa: str, pb: str) -> float:
    """1 for a common range, 0 for ranges that start or end alike (one of the numbers mistyped), else -1."""
    a, b = pa.split(), pb.split()
    if not set(a).isdisjoint(b):
        return 1.0
    return 0.0 if any(m == n for x in a for y in b for m, n in zip(x.split("-"), y.split("-"), strict=True)) else -1.0


@functools.lru_cache(1 << 16)
def _years_agree(ya: str, yb: str) -> float:
    """1 for a common year, 0 for neighbouring ones, else -1."""
    a, b = ya.split(), yb.split()
    if not set(a).isdisjoint(b):
        return 1.0
    return 0.0 if min(abs(int(m) - int(n)) for m in a for n in b) == 1 else -1.0


def compare(left: str, right: str) -> float:
    """The confidence that the rows of two traits are one work; below ``ACCEPT`` is no match."""
    ta, na, ya, va, pa, ra, da, _ = left.split("\t")
    tb, nb, yb, vb, pb, rb, db, _ = right.split("\t")
    if da and db and da != db:
        return 0.0
    # the cheap traits first: most pairs that a key brings together by chance end here
    one = bool(da and db)
    p = (1.0 if pa == pb else _pages_agree(pa, pb)) if pa and pb else 0.0
    if p < 0 and not one:
        return 0.0
    v = 0.0
    if va and vb:
        v = 1.0 if va == vb or any(venues_agree(m, n) for m in va.split() for n in vb.split()) else -1.0
    if v < 0 and p <= 0 and not one:
        return 0.0
    y = known = 0.0
    if ya and yb:
        known = 1.0
        y = 1.0 if ya == yb else _years_agree(ya, yb)
        if y == 0:
            y = 0.5 if ra != rb else 0.0
        elif y < 0 and not (v > 0 and p > 0) and not one:
            return 0.0
    same = ta == tb and ":" not in ta
    if not same:
        la, lb = ta.split(), tb.split()
        sa, sb = {t for t in la if t[0] != ":"}, {t for t in lb if t[0] != ":"}
        common = sa & sb
        if not common and v <= 0 and p <= 0 and y <= 0:
            return 0.0  # other titles need a venue, pages or a year in common
    elif not ta:
        return 0.0
    au = (1.0 if na == nb else authors_agree(na.split(), nb.split())) if na and nb else None
    if au is not None and au < 0.34:
        return 0.0
    cut_short, partial, t = False, False, 1.0
    if same:
        xa = xb = ta.partition(" ")[0]
    elif common:
        xa = xb = min(common)
    else:
        cut_short = any(":" + t in la for t in sb) or any(":" + t in lb for t in sa)
        (t, partial), xa, xb = max(((_titles(m, n), m, n) for m in sa for n in sb), default=((0.0, False), "", ""))
    if t < 0.6:
        return 0.0
    least = min(len(xa), len(xb))
    strong = (au or 0) >= 0.6 and y > 0
    soft = t >= 0.9 and (cut_short or (least >= 12 and _replaced(xa, xb) <= 3))
    if xa != xb and v <= 0 and p <= 0 and not (soft and strong):
        return 0.0
    if partial and not (p > 0 or (v > 0 and y > 0) or (soft and strong)):
        return 0.0
    if partial and least < 12 and not ((p > 0 or v > 0 or cut_short) and strong):
        return 0.0
    if t < 0.8 and not (v > 0 and p > 0):
        return 0.0
    if y == 0.0 and known and v <= 0 and p <= 0:
        return 0.0
    w = WEIGHTS
    return w[0] * t + w[1] * (0.5 if au is None else au) + w[2] * max(y, 0) + w[3] * (0.5 if v == 0 else v) + w[4] * (0.5 if p == 0 else p)


def _close(a: str, b: str, near: int) -> bool:
    """Whether two sorted neighbours differ by ``near`` changes at most."""
    if abs(len(a) - len(b)) > near or a[0] != b[0]:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) <= near and len(y) <= near:
        return True
    # two changes are left, one at either end: what is between them stands in both
    return (near > 2 or len(x) < 7 or x[2:-2] in y) and distance(x, y, near) <= near


def neighbours(values: DataFrame, window: int = WINDOW, near: int | None = NEAR) -> DataFrame:
    """(a, b): the pairs of different values (columns ``k``, and ``r``: whether records have it) that
    stand within the window in sorted order, ``b`` one of records.  Pairs differ by ``near`` changes
    at most (None: by any).

    The window slides inside each range of the sorted values; the values at the
    ranges' edges then slide once more, all in one order (2 ``window`` values a range)."""

    def met(o: str, k: str) -> bool:
        return near is None or _close(o, k, near)

    def ordered(o: str, ro: bool, k: str, rk: bool) -> list[tuple[str, str]]:
        return [(o, k)] * rk + [(k, o)] * ro

    def slide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last: list[tuple[str, bool]] = []
        first: list[tuple[str, bool]] = []
        for pdf in parts:
            rows = []
            for k, r in zip(pdf["k"].tolist(), pdf["r"].tolist(), strict=True):
                rows += [(*p, -1) for o, ro in last if (r or ro) and met(o, k) for p in ordered(o, ro, k, r)]
                if len(first) < window:
                    first.append((k, r))
                last = [*last[-window + 1 :], (k, r)]
            yield pd.DataFrame(rows, columns=["a", "b", "part"])
        edge = dict.fromkeys([*first, *last])
        yield pd.DataFrame([(k, "r" if r else "", part) for k, r in edge], columns=["a", "b", "part"])

    def across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list[tuple[str, bool, int]] = []
        for pdf in parts:
            rows = []
            for k, b, part in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["part"].tolist(), strict=True):
                r = b == "r"
                rows += [p for o, ro, q in last if q != part and (r or ro) and met(o, k) for p in ordered(o, ro, k, r)]
                last = [*last[-window + 1 :], (k, r, part)]
            yield pd.DataFrame(rows, columns=["a", "b"])

    one = values.groupBy("k").agg(F.max("r").alias("r"))
    out = landed(one.repartitionByRange("k").sortWithinPartitions("k").mapInPandas(slide, "a string, b string, part int"), "neighbours")
    edges = out.filter("part >= 0").repartition(1).sortWithinPartitions("a")
    return out.filter("part < 0").select("a", "b").unionByName(edges.mapInPandas(across, "a string, b string"))


def _tiles(lh: DataFrame, rh: DataFrame, crowded: DataFrame) -> DataFrame:
    """(ia, ib): all rows (ia, h) and (ib, h) of one crowded key value (h, count), in tiles of about ``BLOCK`` records, so that no task has a whole value."""
    of = crowded.select("h", F.ceil(F.col("count") / F.lit(BLOCK + 1)).cast("int").alias("m"))
    right = rh.join(of, "h").select("ib", "h", F.pmod(F.xxhash64("ib"), F.col("m")).cast("int").alias("tile"))
    left = lh.distinct().join(of, "h").select("ia", "h", F.explode(F.expr("sequence(0, m - 1)")).alias("tile"))
    return left.join(right, ["h", "tile"]).select("ia", "ib")


def candidates(left: DataFrame, right: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ia, ib): ids of rows that some sort key brings together; ``right``'s rows are among ``left``'s or beside them."""
    near = neighbours(_slid(left).withColumn("r", F.lit(False)).unionByName(_slid(right).withColumn("r", F.lit(True))), window)
    near = near.select(F.xxhash64("a").alias("h"), F.xxhash64("b").alias("hb"))
    lh, rh = left.select(F.col("id").alias("ia"), F.explode("hs").alias("h")), right.select(F.col("id").alias("ib"), F.explode("hs").alias("h"))
    crowded = landed(rh.groupBy("h").count().filter(F.col("count") > BLOCK), "crowded")
    some = not crowded.isEmpty()
    all_rh = rh
    if some:
        rh = rh.join(crowded.select("h"), "h", "left_anti")
    beside = lh.join(near, "h").select("ia", F.col("hb").alias("h"))
    met = lh.join(rh, "h").select("ia", "ib").unionByName(beside.join(rh, "h").select("ia", "ib"))
    return met.unionByName(_tiles(lh.unionByName(beside), all_rh, crowded)) if some else met


def scored(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ia, ib, confidence) of the pairs that match."""
    a = left.select(F.col("id").alias("ia"), F.col("traits").alias("fa"))
    b = right.select(F.col("id").alias("ib"), F.col("traits").alias("fb"))

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            conf = pa.array([compare(x, y) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)], pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column("ia"), batch.column("ib"), conf], ["ia", "ib", "confidence"])
            yield out.filter(pc.greater_equal(conf, ACCEPT))

    # pairs lie by their left row before they are told apart, so that no further exchange is needed to meet its traits
    one = pairs.repartition("ia").dropDuplicates(["ia", "ib"])
    return one.join(a, "ia").join(b, "ib").select("ia", "ib", "fa", "fb").mapInArrow(op, "ia long, ib long, confidence double")


def components(edges: DataFrame) -> DataFrame:
    """(id, work) of the nodes with edges (ia, ib): the smallest id of each one's connected component."""
    turned = edges.select(F.col("ib").alias("ia"), F.col("ia").alias("ib"))
    loops = turned.unionByName(edges.select("ia", "ib")).select("ia", F.col("ia").alias("ib"))
    both = landed(edges.select("ia", "ib").unionByName(turned).unionByName(loops).distinct(), "links")
    labels = landed(both.groupBy(F.col("ia").alias("id")).agg(F.min("ib").alias("work")), "labels")
    while True:
        own = F.max(F.when(F.col("ia") == F.col("ib"), F.col("work")))
        low = both.join(labels.withColumnRenamed("id", "ib"), "ib").groupBy(F.col("ia").alias("id")).agg(F.min("work").alias("work"), own.alias("own"))
        new = landed(low.select("id", "work", (F.col("work") < F.col("own")).alias("moved")), "labels")
        if new.filter("moved").isEmpty():
            return new.select("id", "work")
        # a label's own label: long chains are followed in a number of steps that is the logarithm of their length
        up = new.select(F.col("id").alias("work"), F.col("work").alias("top"))
        labels = landed(new.join(up, "work").select("id", F.col("top").alias("work")), "labels")


def assigned(options: pd.DataFrame) -> pd.DataFrame:
    """(entry_id, work, confidence): entries and works of one document (entry_id, work, confidence) one to one with the
    greatest total confidence; entries that get none keep their best work."""
    by: dict[str, dict[int, float]] = defaultdict(dict)
    for e, w, c in zip(options["entry_id"], options["work"], options["confidence"], strict=True):
        by[e][w] = max(c, by[e].get(w, 0.0))
    holder: dict[int, str] = {}
    got: dict[str, int] = {}
    price: dict[int, float] = defaultdict(float)
    # auction with small steps: who is outbid moves on to what is then worth most to him
    step = 1e-4
    waiting = sorted(by, reverse=True)
    while waiting:
        e = waiting.pop()
        worth = sorted(((c - price[w], -w) for w, c in by[e].items()), reverse=True)
        best, w = worth[0][0], -worth[0][1]
        if best <= 0:
            continue
        price[w] += best - max(worth[1][0] if len(worth) > 1 else 0.0, 0.0) + step
        if w in holder:
            waiting.append(holder[w])
            got.pop(holder[w])
        holder[w], got[e] = e, w
    rows = []
    for e, works in by.items():
        w = got.get(e, min(works, key=lambda x: (-works[x], x)))
        rows.append((e, w, works[w]))
    return pd.DataFrame(rows, columns=["entry_id", "work", "confidence"])


def match(entries: DataFrame, records: DataFrame, window: int = WINDOW) -> DataFrame:
    """(entry_id, record_id, confidence): every citation with each record of the work it cites.

    Records of one DOI are one unit, and so are those of one title, first author
    and year without a DOI.  Citations and units go through one search and one
    comparison, among the units too; units that compare as one are one work, and
    a citation's best work is its own."""
    r = landed(record_features(records).select("id", "traits", "unit"), "record-features")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in entries.columns else F.lit("")
    # odd ids are citations: the places of their rows in the table written here
    e = landed(entry_features(entries.withColumn("entry_id", F.concat(doc, F.lit(_SEP), "entry_id"))).select((2 * F.monotonically_increasing_id() + 1).alias("ia"), "id", "traits", "hs"), "entry-features")
    units, seed = merged(r), 0
    while True:
        # a unit's id is a digest of what it is; if two ever shared one, another seed is taken
        digest = F.xxhash64(F.lit(seed), "unit").bitwiseAND(F.lit(-2))
        right = landed(units.select(digest.alias("id"), "traits", "hs"), "match-units")
        if right.groupBy("id").count().filter("count > 1").isEmpty():
            break
        seed += 1
    both = right.unionByName(e.select(F.col("ia").alias("id"), "traits", "hs"))
    cites = lambda c: F.col(c).bitwiseAND(1) == 1
    found = candidates(both, right, window).filter(cites("ia") | (F.col("ia") < F.col("ib")))
    links = landed(scored(both, right, found), "match-links")
    label = components(links.filter(~cites("ia")))
    at = links.filter(cites("ia")).join(label.withColumnRenamed("id", "ib"), "ib", "left").select("ia", F.coalesce("work", "ib").alias("work"), "confidence")
    of = Window.partitionBy("ia")
    ranked = at.repartition("ia").groupBy("ia", "work").agg(F.max("confidence").alias("confidence"))
    ranked = ranked.withColumn("n", F.row_number().over(of.orderBy(F.desc("confidence"), "work"))).withColumn("of", F.count("*").over(of))
    options = landed(ranked, "match-options")
    own = _one_to_one(e.select(F.col("id").alias("entry_id"), "ia"), options)
    plain = F.expr("substring(entry_id, instr(entry_id, '\x1f') + 1)")
    each = own.groupBy(plain.alias("entry_id"), "work").agg(F.max("confidence").alias("confidence"))
    members = r.select(F.col("id").alias("record_id"), digest.alias("id")).join(label, "id", "left").select("record_id", F.coalesce("work", "id").alias("work")).distinct()
    return each.join(members, "work").select("entry_id", "record_id", F.round("confidence", 6).alias("confidence"))


def _one_to_one(mine: DataFrame, options: DataFrame) -> DataFrame:
    """(entry_id, work, confidence): each entry's best work, or, where one of a document's entries that want
    one work has another, what the assignment of that document gives."""
    best = landed(mine.join(options.filter("n = 1"), "ia").select("entry_id", "work", "confidence"), "match-best")
    # an entry of no known document is alone
    doc = F.when(F.col("entry_id").startswith(_SEP), F.col("entry_id")).otherwise(F.split_part("entry_id", F.lit(_SEP), F.lit(1))).alias("doc")
    some = landed(mine.join(options.filter("of > 1"), "ia").select("entry_id", "work", "confidence", doc), "match-several")
    if some.isEmpty():
        return best
    wanted = some.select("doc", "work").distinct()
    rivals = best.select("entry_id", "work", "confidence", doc).join(wanted, ["doc", "work"]).select(*some.columns)
    solved = some.unionByName(rivals).groupBy("doc").applyInPandas(assigned, "entry_id string, work long, confidence double")
    solved = landed(solved, "match-assigned")
    return best.join(solved.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(solved)
