"""Noise in text from scanned pages (problem 2).

Layout: a line is a running header when it is the first of its page, stands
further from the next line than the page's lines do from one another, and is no
heading; a folio holds only a page number and stands apart at an edge of its page.
Inside a citation's text, a line between others that holds only a page number,
or a venue's letters, year and page number, is one of these.

Lexicon: the words of all lines with their counts, and the pairs of neighbours.
A symmetric-delete index of the frequent words (every word under each string that
deleting one or two confusable pieces leaves) meets the same deletions of the rare
ones; of the candidates that come out, those that confusion pairs explain are
kept, the cheapest wins, then the more frequent beside the same neighbours
(bigrams), then the more frequent word.

Broken words: a line's last part and the next line's first part are one word,
unless the joined word is rarer than the hyphenated one (its own hyphen).

Defined results: null and empty texts are no lines; rows delivered twice give one
result; words whose right form stands nowhere else are left as they are; ties take
the smaller word; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.lookalike import HIDDEN, LOOKALIKES
from quire.session import landed

#: Words whose hashes every worker holds at most (8 bytes each); more of them meet all tokens in a join.
HELD = 300_000

# What is printed and what a scan reads instead.
CONFUSIONS = [
    ("e", "c"), ("i", "!"), ("a", "@"), ("i", "l"), ("t", "f"), ("o", "0"), ("n", "ri"), ("c", "("), ("s", "5"), ("l", "1"), ("u", "ii"), ("l", "|"),
    ("g", "q"), ("h", "b"), ("m", "rn"), ("d", "cl"), ("in", "m"), ("ri", "n"), ("b", "6"), ("w", "vv"), ("li", "h"), ("rn", "m"), ("cl", "d"),
    ("i", "1"), ("i", "|"), ("o", "c"), ("g", "9"), ("z", "2"), ("s", "$"), ("b", "8"), ("vv", "w"), ("nn", "m"), ("l", "i"), ("l", "!"),
]
#: A right word is so many times as frequent as its misreading; it stands this often at least.
RATIO, LEAST = 12, 4
#: Confusions in one word at most.
MOST = 2

_BREAK = r"[-‐¬=­]"
_END = "“”\"'‘’)]}>.,;:?!»*"
_START = "“”\"'‘’[{<„«*"


def clean(token: str) -> str:
    """A token in lower case without punctuation around (a bracket that only opens may be a misread c)."""
    if token.isalpha():
        return token.lower()
    t = token.rstrip(_END).lstrip(_START)
    if t[:1] == "(" and (")" in token or not t[1:2].isalpha()):
        t = t.lstrip("(")
    return t.lower()


_DIGIT = "[0-9lIO]"
FOLIO = rf"(?i)^\s*(?:page\s+{_DIGIT}+(?:\s+of\s+{_DIGIT}+)?|p\.\s*{_DIGIT}+|[-–—]\s*{_DIGIT}+\s*[-–—]|\[\s*{_DIGIT}+\s*\]|{_DIGIT}{{1,4}}\s*\|?|\|\s*{_DIGIT}{{1,4}})\s*$"
RAW_FOLIO = rf"(?i)^\s*(?:page\s+{_DIGIT}+|[-–—]\s*{_DIGIT}+\s*[-–—]|\[\s*{_DIGIT}+\s*\]|p\.\s*{_DIGIT}+|{_DIGIT}{{1,3}}\s*\|?)\s*$"
RAW_HEADER = rf"^\s*(?:[A-Z][A-Z!@(|015]{{3,5}}\s+[12]{_DIGIT}{{3}}\s+{_DIGIT}{{1,4}}|{_DIGIT}{{1,4}}\s+[A-Z][A-Z!@(|015]{{3,5}}\s+[12]{_DIGIT}{{3}})\s*$"

LINES = "tbl string, doc_id long, page int, line_no int, sub int, text string, kind string, right string, first boolean"
_NAMES = [f.split()[0] for f in LINES.split(", ")]
_FOLIO, _RAW_FOLIO, _RAW_HEADER = re.compile(FOLIO), re.compile(RAW_FOLIO), re.compile(RAW_HEADER)
_RUNS_ON = re.compile(r"(?:pages|pp\.?|\d\s*[-–—]|[\d(])\s*\Z", re.I)
_LABEL = re.compile(r"\A\s*\[\s*\d+\s*\]\s*")
_BROKEN = re.compile(r"[^\W\d_][-‐¬=­]\s*\Z")


def _kinds(lines: list[tuple[int, str, float, float]]) -> list[str | None]:
    """What each line (line_no, text, y0, size) of a page is."""
    kinds: list[str | None] = [None] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: (lines[i][2], lines[i][0]))
    ys = [lines[i][2] for i in order]
    sizes = Counter(x[3] for x in lines)
    body = max(sizes, key=lambda z: (sizes[z], z))
    # in reading order, so that the columns of a page don't mix; a page of few lines may show no usual gap
    gaps = [b[2] - a[2] for a, b in zip(lines, lines[1:], strict=False) if b[2] - a[2] >= max(1.0, 0.9 * body)]
    leading = min(gaps) if len(gaps) > 3 else min([*gaps, 1.3 * body])
    apart = leading * 1.1
    if len(order) > 1:
        first, last = order[0], order[-1]
        if ys[1] - ys[0] > apart and lines[first][3] <= body + 0.4:
            kinds[first] = "folio" if _FOLIO.match(lines[first][1]) else "header"
        if ys[-1] - ys[-2] > apart and _FOLIO.match(lines[last][1]):
            kinds[last] = "folio"
    elif _FOLIO.match(lines[0][1]):
        kinds[0] = "folio"
    return kinds


def _rights(texts: list[str], kinds: list[str | None]) -> list[tuple[str | None, bool]]:
    """For each line the first part of the next body line, if it ends in a broken word, and whether it is the first body line."""
    out: list[tuple[str | None, bool]] = [(None, False)] * len(texts)
    body = [i for i, k in enumerate(kinds) if k is None and texts[i].strip()]
    for n, i in enumerate(body):
        right = texts[body[n + 1]].split(None, 1)[0] if n + 1 < len(body) and _BROKEN.search(texts[i]) else None
        out[i] = (right, n == 0)
    return out


def page_lines(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines of all pages with their kind (header, folio, null: body), in one pass over each page's parts."""
    at = ["doc_id", "page", "line_no"]
    a = spans.select(F.lit("spans").alias("tbl"), *at, "span_no", "text", "y0", "size")
    b = pages.select(F.lit("page_lines").alias("tbl"), *at, F.lit(0).alias("span_no"), "text", "y0", "size")
    rows = a.unionByName(b).filter("text IS NOT NULL AND doc_id IS NOT NULL AND page IS NOT NULL AND line_no IS NOT NULL").fillna(0, ["span_no"])
    ready = rows.repartition("doc_id", "page").sortWithinPartitions("tbl", "doc_id", "page", "line_no", "span_no", "text")

    def page(key: tuple, parts: list[tuple]) -> list[tuple]:
        lines: list[tuple[int, str, float, float]] = []
        seen: tuple | None = None
        for line_no, span_no, text, y0, size in parts:
            if (line_no, span_no) == seen:
                continue  # delivered twice
            seen = (line_no, span_no)
            y0, size = (0.0 if y0 is None or y0 != y0 else y0), (0.0 if size is None or size != size else size)
            if lines and lines[-1][0] == line_no:
                _, t, y, z = lines[-1]
                lines[-1] = (line_no, t + text, min(y, y0), max(z, size))
            else:
                lines.append((line_no, text, y0, size))
        kinds = _kinds(lines)
        rights = _rights([x[1] for x in lines], kinds)
        return [(*key, x[0], 0, x[1], k, r, f) for x, k, (r, f) in zip(lines, kinds, rights, strict=True)]

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        parts: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for tbl, doc, pg, line_no, span_no, text, y0, size in zip(*[pdf[c].tolist() for c in ("tbl", "doc_id", "page", "line_no", "span_no", "text", "y0", "size")], strict=True):
                if (tbl, doc, pg) != key:
                    if parts:
                        out += page(key, parts)
                    key, parts = (tbl, doc, pg), []
                parts.append((line_no, span_no, text, y0, size))
            yield pd.DataFrame(out, columns=_NAMES)
        if parts:
            yield pd.DataFrame(page(key, parts), columns=_NAMES)

    return ready.mapInPandas(op, LINES)


def raw_lines(bib: DataFrame) -> DataFrame:
    """The lines inside citations; page is 0 and line_no the entry's number."""

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, no, raw in zip(pdf["doc_id"].tolist(), pdf["entry_no"].tolist(), pdf["raw"].tolist(), strict=True):
                texts = _LABEL.sub("", raw).split("\n")
                kinds: list[str | None] = [None] * len(texts)
                for i in range(1, len(texts) - 1):
                    if _RAW_HEADER.match(texts[i]):
                        kinds[i] = "header"
                    elif _RAW_FOLIO.match(texts[i]) and not _RUNS_ON.search(texts[i - 1]):
                        kinds[i] = "folio"
                rights = _rights(texts, kinds)
                out += [("bib_entries", doc, 0, no, i, t, k, r, False) for i, (t, k, (r, _)) in enumerate(zip(texts, kinds, rights, strict=True))]
            yield pd.DataFrame(out, columns=_NAMES)

    return bib.filter("raw IS NOT NULL AND doc_id IS NOT NULL AND entry_no IS NOT NULL").select("doc_id", "entry_no", "raw").mapInPandas(op, LINES)


def _form(text: str) -> str:
    """A word in lower case with look-alikes and hidden characters put right."""
    if text.isascii():
        return text.lower()
    return "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKC", text) if c not in HIDDEN).lower()


def breaks(lines: DataFrame) -> DataFrame:
    """(tbl, doc_id, page, line_no, sub, mark, joined, hyphened, capital, left) of the body lines that end in a broken word."""

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for tbl, doc, page, line, sub, text, right in pdf.itertuples(index=False):
                shown = text.split()[-1]
                part, mark = shown[:-1], shown[-1]
                if not part or not part[-1].isalpha() or not right or not (right[0].isalpha() or right[0] in "!@(|1056"):
                    continue
                left, r = _form(part.lstrip(_START).lstrip("(")), _form(right.rstrip(_END))
                if left and r:
                    rows.append((tbl, doc, page, line, sub, mark, left + r, f"{left}-{r}", right[:1].isupper() and not part.isupper(), left))
            yield pd.DataFrame(rows, columns=["tbl", "doc_id", "page", "line_no", "sub", "mark", "joined", "hyphened", "capital", "left"])

    at = ["tbl", "doc_id", "page", "line_no", "sub", "text"]
    broken = lines.filter(F.col("kind").isNull() & F.col("text").rlike(r"\p{L}" + _BREAK + r"\s*$"))
    first = lines.filter("first").select("tbl", "doc_id", (F.col("page") - 1).alias("page"), F.element_at(F.split(F.trim("text"), r"\s+"), 1).alias("turned"))
    turned = broken.filter("right IS NULL AND tbl <> 'bib_entries'").select(*at).join(first, ["tbl", "doc_id", "page"]).select(*at, F.col("turned").alias("right"))
    schema = "tbl string, doc_id long, page int, line_no int, sub int, mark string, joined string, hyphened string, capital boolean, left string"
    return broken.filter("right IS NOT NULL").select(*at, "right").unionByName(turned).mapInPandas(op, schema)


#: Readings of tokens that a worker remembers at most, and pairs of neighbours that it counts before they go on.
MEMO, PAIRS = 300_000, 200_000


def remembered(read):
    """``read`` of a token with a bounded memory."""
    memo: dict = {}

    def get(token: str):
        try:
            return memo[token]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            out = memo[token] = read(token)
            return out

    return get


def whole_words(text: str) -> Iterator[tuple[int, str, str]]:
    """(place, shown, word) of a line's tokens but a broken last one."""
    shown = text.split()
    if shown and _BROKEN.search(text):
        shown.pop()
    for i, t in enumerate(shown):
        yield i, t, clean(t)


_ODD = r"[!@(|$0-9]"
_HAS_ODD = re.compile(_ODD)


def lexicon(lines: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(word, n, capital): counts of the body lines' whole words and of structured
    texts, and how many show a capital (a line's first word may be the rest of a
    broken one: it is listed only if it is odd, and counts 0)."""

    def rows(shown: Counter[str], odd: set[str]) -> pd.DataFrame:
        n: Counter[str] = Counter()
        capital: Counter[str] = Counter()
        for t, k in shown.items():
            if w := clean(t):
                n[w] += k
                if t[0].isupper() or (not t[0].isalpha() and t[1:2].isupper()):
                    capital[w] += k
        for t in odd:
            if w := clean(t):
                n[w] += 0
        return pd.DataFrame({"word": list(n), "n": list(n.values()), "capital": [capital[w] for w in n]})

    def count(structured: bool):
        def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shown: Counter[str] = Counter()
            odd: set[str] = set()
            for pdf in parts:
                for text in pdf.iloc[:, 0].tolist():
                    toks = text.split()
                    if not structured and toks:
                        if _BROKEN.search(text):
                            toks.pop()
                        if toks and _HAS_ODD.search(toks[0]):
                            odd.add(toks[0])
                        del toks[:1]
                    shown.update(toks)
                if len(shown) + len(odd) > 200_000:
                    yield rows(shown, odd)
                    shown.clear()
                    odd.clear()
            if shown or odd:
                yield rows(shown, odd)

        return op

    schema = "word string, n long, capital long"
    parts = lines.filter("kind IS NULL").select("text").mapInPandas(count(False), schema)
    if fields is not None:
        parts = parts.unionByName(fields.filter("text IS NOT NULL").select("text").mapInPandas(count(True), schema))
    return parts.filter(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.sum("n").alias("n"), F.sum("capital").alias("capital"))


def field_texts(df: DataFrame, *columns: str) -> DataFrame:
    """(text) of structured columns, which no scan went through."""
    return df.select(F.concat_ws(" ", *columns).alias("text"))


_PRINTED = sorted({a for a, _ in CONFUSIONS})
_READ = sorted({b for _, b in CONFUSIONS})


def deletions(word: str, pieces: list[str], depth: int) -> set[str]:
    """What deleting up to ``depth`` confusable pieces leaves, with a mark at each place.

    A word and its misreading leave the same string under the same deletions,
    whichever piece was read for which."""
    spots = [(i, i + len(p)) for p in pieces for i in range(len(word) - len(p) + 1) if word.startswith(p, i)]
    out = {f"{word[:i]}\x00{word[j:]}" for i, j in spots}
    if depth > 1:
        out |= {f"{word[:i]}\x00{word[j:k]}\x00{word[m:]}" for i, j in spots for k, m in spots if k >= j}
    return out


def explained(read: str, right: str, most: int = MOST) -> int | None:
    """The least number of confusions that make ``read`` of ``right``; None if they can't."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(right) + 1):
        for j in range(len(read) + 1):
            cost = best.get((i, j))
            if cost is None:
                continue
            steps = [(right[i : i + 1], right[i : i + 1], 0)] if i < len(right) else []
            steps += [(a, b, 1) for a, b in CONFUSIONS] if cost < most else []
            for a, b, c in steps:
                if a and right.startswith(a, i) and read.startswith(b, j):
                    k = (i + len(a), j + len(b))
                    if best.get(k, most + 1) > cost + c:
                        best[k] = cost + c
    return best.get((len(right), len(read)))


def corrections(lex: DataFrame, more: DataFrame) -> DataFrame:
    """(word, right, cost, n_right): candidate right words of rare or odd words.

    Words and right words have 4 to 60 letters: shorter ("f0r") and longer ones are left as they are.

    ``more``: further words (column ``word``) to put right, such as joined ones."""
    asked = lex.select("word", "n").unionByName(more.select("word", F.lit(0).cast("long").alias("n"))).groupBy("word").agg(F.max("n").alias("n"))
    asked = asked.filter((F.length("word") >= 4) & (F.length("word") <= 60) & F.col("word").rlike(r"\p{L}"))
    right = lex.filter((F.col("n") >= LEAST) & (F.length("word") >= 4) & (F.length("word") <= 60) & ~F.col("word").rlike(_ODD)).select(F.col("word").alias("right"), F.col("n").alias("n_right"))

    def spread(column: str, pieces: list[str]):
        def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for k in range(0, len(pdf), 2000):
                    rows = [(d, *r) for r in pdf.iloc[k : k + 2000].itertuples(index=False) for d in deletions(r[0], pieces, 1 if len(r[0]) < 7 else MOST)]
                    yield pd.DataFrame(rows, columns=["d", column, f"n_{column}"])

        return op

    a = asked.select("word", F.col("n").alias("n_word")).mapInPandas(spread("word", _READ), "d string, word string, n_word long")
    b = right.mapInPandas(spread("right", _PRINTED), "d string, right string, n_right long")
    a, b = a.select(F.xxhash64("d").alias("d"), "word", "n_word"), b.select(F.xxhash64("d").alias("d"), "right", "n_right")
    met = a.join(b, "d").filter((F.col("word") != F.col("right")) & (F.col("n_right") >= RATIO * F.col("n_word"))).select("word", "right", "n_right").distinct()

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            costs = [explained(w, r) for w, r in zip(pdf["word"], pdf["right"], strict=True)]
            out = pdf.assign(cost=[-1 if c is None else c for c in costs])
            yield out[out["cost"] > 0]

    return met.mapInPandas(score, "word string, right string, n_right long, cost int")


def _held(words: DataFrame):
    """The sorted 64-bit hashes of words (column ``word``), for every worker: the driver sees 8 bytes a word, no text."""
    h = words.select(F.xxhash64("word").alias("h")).toArrow().column("h").to_numpy()
    return words.sparkSession.sparkContext.broadcast(np.sort(h))


def _among(hashes: np.ndarray, word: str) -> bool:
    """Whether a word's hash, as Spark's xxhash64 gives it, is one of these (another word of that hash is told apart by a join)."""
    h = xxhash.xxh64_intdigest(word, 42)
    h -= (h >> 63) << 64
    i = hashes.searchsorted(h)
    return i < len(hashes) and int(hashes[i]) == h


def _beside(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(left, word, n): how often each of ``words`` stands right of another word."""
    held = _held(words)

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[tuple[str, str]] = Counter()
        hashes = held.value

        def read(token: str) -> tuple[str, bool]:
            w = clean(token)
            return w, _among(hashes, w)

        get = remembered(read)
        for pdf in parts:
            for text in pdf["text"].tolist():
                shown = text.split()
                if shown and _BROKEN.search(text):
                    shown.pop()
                left = ""
                for t in shown:
                    w, asked = get(t)
                    if asked:
                        n[left, w] += 1
                    left = w
            if len(n) > PAIRS:
                yield pd.DataFrame([(a, b, c) for (a, b), c in n.items()], columns=["left", "word", "n"])
                n.clear()
        yield pd.DataFrame([(a, b, c) for (a, b), c in n.items()], columns=["left", "word", "n"])

    near = lines.filter("kind IS NULL").select("text").mapInPandas(op, "left string, word string, n long").groupBy("left", "word").agg(F.sum("n").alias("n"))
    return near.join(words, "word", "left_semi").select("left", "word", "n")


def picked(cands: DataFrame, lines: DataFrame) -> DataFrame:
    """(word, right): the best candidate of each word: the cheapest, then the one
    most often beside the word's left neighbours, then the most frequent, then the smallest."""
    least = Window.partitionBy("word")
    cheap = cands.withColumn("least", F.min("cost").over(least)).filter("cost = least").withColumn("many", F.count("*").over(least))
    single = cheap.filter("many = 1").select("word", "right")
    tied = landed(cheap.filter("many > 1").select("word", "right", "n_right"), "scan-ties")
    words = tied.select("word").unionByName(tied.select(F.col("right").alias("word"))).distinct()
    asked = words.count()
    if not asked:
        return single
    if asked <= HELD:
        near = landed(_beside(lines, words), "scan-bigrams")
    else:
        near = landed(tokens(lines).join(words, "word", "left_semi").groupBy("left", "word").agg(F.count("*").alias("n")), "scan-bigrams")
    wanted = near.select("word", "left", F.col("n").alias("w")).join(tied, "word")
    grams = near.select("left", F.col("word").alias("right"), F.col("n").alias("g"))
    support = wanted.join(grams, ["left", "right"]).groupBy("word", "right").agg(F.sum(F.col("w") * F.log1p("g")).alias("support"))
    order = Window.partitionBy("word").orderBy(F.desc(F.coalesce("support", F.lit(0.0))), F.desc("n_right"), "right")
    best = tied.join(support, ["word", "right"], "left").withColumn("n", F.row_number().over(order)).filter("n = 1").select("word", "right")
    return single.unionByName(best)


def tokens(lines: DataFrame) -> DataFrame:
    """(tbl, doc_id, page, line_no, sub, i, shown, word, left) of the body lines' whole words."""

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for *at, text in pdf.itertuples(index=False):
                left = ""
                for i, t, w in whole_words(text):
                    rows.append((*at, i, t, w, left))
                    left = w
            yield pd.DataFrame(rows, columns=["tbl", "doc_id", "page", "line_no", "sub", "i", "shown", "word", "left"])

    schema = "tbl string, doc_id long, page int, line_no int, sub int, i int, shown string, word string, left string"
    return lines.filter("kind IS NULL").select("tbl", "doc_id", "page", "line_no", "sub", "text").mapInPandas(op, schema)


_DATE = re.compile(r"(?:[1lI|!]9[0-9oOlI|]{2}|2[0oO][0-9oOlI|]{2})\Z")
_TO_DIGITS = str.maketrans("oOlI|!", "001111")


def year_of(word: str) -> str | None:
    """The year that a token with letters for digits stands for."""
    if len(word) == 4 and not word.isdigit() and _DATE.match(word):
        y = word.translate(_TO_DIGITS)
        return y if y.isdigit() and y[:2] in ("19", "20") else None
    return None


def _fits(shown: str, word: str, i: int, capital: int) -> bool:
    """A capital inside a line where the right word never shows one is a name's."""
    return i == 0 or capital > 0 or bool(_HAS_ODD.search(word)) or not shown.lstrip("“”\"'([{")[:1].isupper()


class Repair:
    """The shared stages of the queries, each written once to the shared folder."""

    def __init__(self, spans: DataFrame, pages: DataFrame, bib: DataFrame, fields: DataFrame | None = None) -> None:
        self.lines = landed(page_lines(spans, pages).unionByName(raw_lines(bib)), "scan-lines")
        self.breaks = landed(breaks(self.lines), "scan-breaks")
        self.lexicon = landed(lexicon(self.lines, fields), "scan-lexicon")
        more = self.breaks.select(F.col("joined").alias("word")).distinct()
        cands = landed(corrections(self.lexicon, more), "scan-candidates")
        capital = self.lexicon.select(F.col("word").alias("right"), "capital")
        self.right = landed(picked(cands, self.lines).join(capital, "right"), "scan-right")

    def split_words(self) -> DataFrame:
        """(tbl, doc_id, page, line_no, sub, word, joined, left): the whole words of the broken ones."""
        lex = self.lexicon.select("word", "n")
        marks = self.breaks.groupBy("tbl", "doc_id").agg(F.count_if(~F.col("mark").isin("-", "‐")).alias("other"))
        known = (
            self.breaks.join(lex.select(F.col("word").alias("joined"), F.col("n").alias("nj")), "joined", "left")
            .join(lex.select(F.col("word").alias("hyphened"), F.col("n").alias("nh")), "hyphened", "left")
            .join(self.right.select(F.col("word").alias("joined"), F.col("right").alias("fixed")), "joined", "left")
            .join(marks, ["tbl", "doc_id"], "left")
            .fillna(0, ["nj", "nh"])
        )
        hyphen = F.col("mark").isin("-", "‐")
        unknown = (F.col("nj") == 0) & (F.col("nh") == 0) & F.col("fixed").isNull()
        rarer = (F.col("nh") > F.col("nj")) & (F.col("fixed").isNull() | (F.col("nh") > 0))
        own = hyphen & (rarer | (unknown & F.col("capital")) | ((F.col("other") >= 3) & (F.col("nj") == 0)))
        word = F.when((F.col("nj") > 0) & F.col("fixed").isNull(), F.col("joined")).otherwise(F.coalesce("fixed", "joined"))
        return known.filter(~own).select("tbl", "doc_id", "page", "line_no", "sub", word.alias("word"), "joined", "left")

    def misread_words(self) -> DataFrame:
        """(tbl, doc_id, page, line_no, sub, i, word): the right words of misread tokens that stand on one line.

        Workers hold the hashes of the misread words if there are ``HELD`` of them at most, and the tokens of such a
        hash meet their right words in a join; else all tokens do."""
        schema = "tbl string, doc_id long, page int, line_no int, sub int, i int, word string, year string, free boolean"
        names = [f.split()[0] for f in schema.split(", ")]
        asked = self.right.select("word")
        held = _held(asked) if asked.count() <= HELD else None

        def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = held.value if held is not None else None

            def read(token: str) -> tuple[str, str | None] | None:
                w = clean(token)
                y = year_of(w) if len(w) == 4 else None
                return (w, y) if y or hashes is None or _among(hashes, w) else None

            get = remembered(read)
            for pdf in parts:
                rows = []
                for *at, text in zip(*[pdf[c].tolist() for c in ("tbl", "doc_id", "page", "line_no", "sub", "text")], strict=True):
                    shown = text.split()
                    if shown and _BROKEN.search(text):
                        shown.pop()
                    for i, t in enumerate(shown):
                        if hit := get(t):
                            rows.append((*at, i, *hit, _fits(t, hit[0], i, 0)))
                yield pd.DataFrame(rows, columns=names)

        toks = self.lines.filter("kind IS NULL").select("tbl", "doc_id", "page", "line_no", "sub", "text").mapInPandas(op, schema)
        right = F.coalesce(F.when(F.col("free") | (F.col("capital") > 0), F.col("right")), F.col("year"))
        return toks.join(self.right, "word", "left").withColumn("word", right).filter("word IS NOT NULL").select("tbl", "doc_id", "page", "line_no", "sub", "i", "word")

    def found(self) -> DataFrame:
        """(tbl, doc_id, page, line_no, kind, word)."""
        at = ["tbl", "doc_id", "page", "line_no"]
        split = self.split_words()
        parts = split.select(*at, F.lit("split").alias("kind"), "word")
        one = self.misread_words().select(*at, F.lit("misread").alias("kind"), "word")
        # a broken word that is misread in its first part too
        wrong = split.filter((F.col("word") != F.col("joined")) & ~F.expr("startswith(word, left)"))
        here = wrong.select(*at, F.lit("misread").alias("kind"), "word")
        edges = self.lines.filter("kind IS NOT NULL").select(*at, "kind", F.lit("").alias("word"))
        return parts.unionByName(one).unionByName(here).unionByName(edges).distinct()

    def repaired_lines(self) -> DataFrame:
        """(tbl, doc_id, page, line_no, sub, text, fresh) of the body lines: broken words
        whole on their first line, misread words put right; ``fresh`` where a
        paragraph starts."""
        at = ["tbl", "doc_id", "page", "line_no", "sub"]
        body = self.lines.filter("kind IS NULL AND length(trim(text)) > 0").select(*at, "text")
        joins = self.split_words().groupBy(*at).agg(F.min("word").alias("whole"))
        fixes = self.misread_words().groupBy(*at).agg(F.sort_array(F.collect_set(F.concat_ws(" ", "i", "word"))).alias("fixes"))
        full = body.join(joins, at, "left").join(fixes, at, "left")
        # a citation is one unit, a page another; units are linked at their edges
        unit = ["tbl", "doc_id", "page", F.when(F.col("tbl") == "bib_entries", F.col("line_no")).otherwise(0)]
        w = Window.partitionBy(*unit).orderBy("line_no", "sub")
        seen = full.withColumn("before", F.lag("text").over(w)).withColumn("taken", F.lag(F.col("whole").isNotNull()).over(w)).withColumn("last", F.lead("text").over(w).isNull())
        seen = seen.withColumn("widest", F.max(F.length("text")).over(Window.partitionBy(*unit)))
        turned = seen.filter("last AND tbl <> 'bib_entries'").select("tbl", "doc_id", (F.col("page") + 1).alias("page"), F.col("text").alias("p_text"), F.col("whole").isNotNull().alias("p_taken"))
        linked = seen.join(turned, ["tbl", "doc_id", "page"], "left")
        first = F.col("before").isNull()
        prev = F.when(first, F.col("p_text")).otherwise(F.col("before"))
        taken = F.coalesce(F.when(first, F.col("p_taken")).otherwise(F.col("taken")), F.lit(False))
        heading = r"^\s*\d+(?:\.\d+)*\.?\s+\p{Lu}[^.]{0,80}$"
        ended = prev.rlike(r"[.!?:]['\"”)]*\s*$") & (first | (F.length(prev) < 0.85 * F.col("widest")))
        fresh = prev.isNull() | F.col("text").rlike(heading) | prev.rlike(heading) | (ended & ~taken)
        fresh = F.when((F.col("tbl") == "bib_entries") & ~first, F.lit(False)).otherwise(fresh)

        def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                texts = [_repaired(t, fx, whole, took) for t, fx, whole, took in zip(pdf["text"], pdf["fixes"], pdf["whole"], pdf["taken"], strict=True)]
                yield pdf[["tbl", "doc_id", "page", "line_no", "sub"]].assign(text=texts, fresh=pdf["fresh"])

        ready = linked.select(*at, "text", F.array_join("fixes", "\n").alias("fixes"), "whole", taken.alias("taken"), fresh.alias("fresh"))
        return ready.mapInPandas(op, "tbl string, doc_id long, page int, line_no int, sub int, text string, fresh boolean")

    def paragraphs(self) -> DataFrame:
        """(tbl, doc_id, para, page, text): the repaired text as continuous paragraphs.

        Paragraphs are counted per page and the pages' counts summed, so that no
        task holds a whole volume; a paragraph runs on over page ends."""
        lines = landed(self.repaired_lines(), "scan-repaired")
        unit = ["tbl", "doc_id", "page", F.when(F.col("tbl") == "bib_entries", F.col("line_no")).otherwise(0).alias("part")]
        counted = lines.withColumn("part", F.when(F.col("tbl") == "bib_entries", F.col("line_no")).otherwise(0))
        starts = counted.groupBy(*unit).agg(F.sum(F.col("fresh").cast("int")).alias("n"))
        before = Window.partitionBy("tbl", "doc_id").orderBy("page", "part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = starts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        run = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("tbl", "doc_id", "page", "part").orderBy("line_no", "sub"))
        at = counted.withColumn("k", run).join(offsets, ["tbl", "doc_id", "page", "part"]).withColumn("para", (F.col("k") + F.col("offset")).cast("int"))
        parts = at.groupBy("tbl", "doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "sub", "text"))).alias("ls"))
        text = F.array_join(F.filter(F.transform("ls", lambda x: F.trim(x["text"])), lambda t: t != ""), "\x02")
        # marks that closed a taken part belong to the word before; after an own hyphen nothing stands between
        closed = F.replace(F.regexp_replace(F.regexp_replace(text, "\x02?\x01", ""), r"([\p{L}\p{N}]-)\x02(?=[\p{L}\p{N}])", "$1"), F.lit("\x02"), F.lit(" "))
        return parts.select("tbl", "doc_id", "para", F.col("ls")[0]["page"].alias("page"), closed.alias("text"))


def _cased(right: str, shown: str) -> str:
    """``right`` in the case of what was shown."""
    letters = [c for c in shown if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if shown[:1].isupper() else right


def _put(token: str, right: str) -> str:
    """A token with its word replaced, the punctuation around kept."""
    bare = token.lstrip(_START)
    core = bare.rstrip(_END)
    return token[: len(token) - len(bare)] + _cased(right, core) + bare[len(core) :]


def _repaired(text: str, fixes: str | None, whole: str | None, taken: bool) -> str:
    """One line: its first part gone where the line before took it, its misread
    words right, its broken last word whole."""
    shown = text.split()
    for f in (fixes or "").split("\n"):
        if f:
            i, right = f.split(" ", 1)
            if int(i) < len(shown):
                shown[int(i)] = _put(shown[int(i)], right)
    if whole and shown:
        bare = shown[-1].lstrip(_START)
        shown[-1] = shown[-1][: len(shown[-1]) - len(bare)] + _cased(whole, bare)
    rest = shown[1:] if taken else shown
    if taken and shown:
        mark = shown[0][len(shown[0].rstrip(_END)) :]
        return f"\x01{mark} {' '.join(rest)}" if mark else " ".join(rest)
    return " ".join(rest)
