"""Duplicates hidden by print form (problem 6): recursive radix partitioning.

Each record has canonical bytes, which its copies share.  Records are split into
buckets by the first bytes of these, a bucket above the limit by further bytes, and
so on until each fits; a bucket above it whose records go on alike is split by its
keys.  The records of a bucket then go, one after another, into one path-compressed
trie whose terminals count keys: the trie holds a bucket's distinct forms, not its
records.  A terminal that holds several word forms tells them apart (below), and gives
each set of copies its smallest key and its count.  Counts of a bucket that was split
by keys are added up by form before its forms are told apart.

Canonical bytes of a text: its letters and digits as a sorted bag (fields may
stand in another order, words be joined, split or broken at a hyphen).  A bag
is blind to swapped letters, so a terminal compares word forms: the words that
two forms don't share must spell the same strings when joined.

Canonical bytes of a publication: per field its letters and digits in order, null
apart from empty, and names as bags, whose words are its word form.

Defined results: case, white space, line breaks and punctuation never matter,
accents do; a printed label ([7], (7), 7.) in front of a text is left out; a
row without any letter or digit has no copies; a key delivered several times
counts once; a null key is no record; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import landed

#: Records in one bucket at most (their distinct forms take about 60 MB of Python objects).
BUCKET = 50_000
#: Letters of the canonical bytes by which a bucket is split at a time, and where equal beginnings are split by keys.
STEP, DEEPEST = 4, 64

_LABEL = re.compile(r"\s*(\[\s*\d+\s*\]|\(\s*\d{1,3}\s*\)|\d{1,3}\.(?=\s))")
_BREAK = re.compile(r"[-‐‑–—­¬=]\s*")
_WORD = re.compile(r"[^\W_]+")


def letters(text: str) -> str:
    """The letters and digits of a text in order, in one case."""
    return "".join(_WORD.findall(unicodedata.normalize("NFC", text).casefold()))


def canonical_text(raw: str | None) -> tuple[str, str]:
    """(canonical bytes, word form) of a free text; ('', '') where it has no letters."""
    if raw is None:
        return "", ""
    text = unicodedata.normalize("NFC", _LABEL.sub("", raw, count=1) if _LABEL.match(raw) else raw).casefold()
    bag = "".join(sorted("".join(_WORD.findall(text))))
    if not bag:
        return "", ""
    return bag, " ".join(_WORD.findall(_BREAK.sub("", text)))


def _names(authors: str | None) -> list[list[str]] | None:
    """The words of each name."""
    if authors is None:
        return None
    try:
        names = json.loads(authors)
    except ValueError:
        names = authors
    names = names if isinstance(names, list) else [names]
    return [_WORD.findall(unicodedata.normalize("NFC", str(n)).casefold()) for n in names if n is not None]


def canonical_publication(title, authors, year, venue, pages, doi, url) -> tuple[str, str]:
    """(canonical bytes, word form) of a publication's fields."""
    parts = [None if x is None else letters(str(x)) for x in (title, year, venue, pages, doi, url)]
    names = _names(authors)
    parts.append(None if names is None else ";".join("".join(sorted("".join(n))) for n in names))
    if not any(parts):
        return "", ""
    return "\x1f".join("\x00" if p is None else p for p in parts), " ".join(w for n in names or [] for w in n)


def same_words(a: str, b: str) -> bool:
    """Whether two word forms of one bag differ only in where words join or stand."""
    x, y = a.split(), b.split()
    shared = Counter(x) & Counter(y)

    def rest(words: list[str]) -> list[str]:
        left, out = Counter(shared), []
        for w in words:
            if left[w]:
                left[w] -= 1
            else:
                out.append(w)
        return out

    p, q = rest(x), rest(y)
    if "".join(p) == "".join(q):
        return True
    while p and q:
        for long, short in ((p, q), (q, p)):
            hit = next(((w, i, j) for w in sorted(set(long), key=len, reverse=True) for i in range(len(short)) for j in range(i + 1, len(short) + 1) if "".join(short[i:j]) == w), None)
            if hit:
                long.remove(hit[0])
                del short[hit[1] : hit[2]]
                break
        else:
            return False
    return not p and not q


def _common(a: str, b: str) -> int:
    """How many letters two strings have in common from the start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A path-compressed trie; a terminal holds counters (smallest key, number) by word form."""

    def __init__(self) -> None:
        self.root: dict = {}

    def terminal(self, key: str) -> dict[str, tuple[str, int]]:
        """The counters of a key's terminal, made if there are none."""
        node, rest = self.root, key
        while True:
            edge = node.get(rest[0])
            if edge is None:
                edge = node[rest[0]] = [rest, {}, {}]
            label = edge[0]
            if not rest.startswith(label):  # split the edge
                k = _common(label, rest)
                node[rest[0]] = edge = [label[:k], {label[k]: [label[k:], edge[1], edge[2]]}, {}]
                label = edge[0]
            rest = rest[len(label) :]
            if not rest:
                return edge[2]
            node = edge[1]

    def add(self, key: str, form: str, least: str, n: int) -> None:
        count(self.terminal(key), form, least, n)

    def terminals(self) -> Iterator[tuple[str, dict[str, tuple[str, int]]]]:
        stack = [("", self.root)]
        while stack:
            head, node = stack.pop()
            for label, children, counters in node.values():
                if counters:
                    yield head + label, counters
                if children:
                    stack.append((head + label, children))


def count(counters: dict[str, tuple[str, int]], form: str, least: str, n: int) -> None:
    """Add ``n`` keys, ``least`` the smallest, to a terminal's counter of a form."""
    old = counters.get(form)
    counters[form] = (min(old[0], least), old[1] + n) if old else (least, n)


def _terminal_sets(counters: dict[str, tuple[str, int]]) -> Iterator[tuple[list[str], str, int]]:
    """The sets of word forms that are copies, each with its smallest key and count.

    Forms of the same words in any order are one at once; only what is left is compared."""
    if len(counters) == 1:
        ((form, (least, n)),) = counters.items()
        yield [form], least, n
        return
    alike: dict[str, list[str]] = {}
    for form in sorted(counters):
        alike.setdefault(" ".join(sorted(form.split())), []).append(form)
    sets: list[list[str]] = []
    for forms in alike.values():
        for s in sets:
            if same_words(s[0], forms[0]):
                s.extend(forms)
                break
        else:
            sets.append(forms)
    for s in sets:
        yield s, min(counters[f][0] for f in s), sum(counters[f][1] for f in s)


_COUNTED = "tbl string, canon string, form string, least string, n long"
_COUNTED_NAMES = [f.split()[0] for f in _COUNTED.split(", ")]


def _count(told_apart: bool):
    """A mapInArrow function over rows (tbl, bucket, canon, form, key) sorted so: each bucket's trie, its
    terminals' forms (``told_apart``: with the least key and number of their set, else with their own)."""

    def out(tbl: str, trie: Trie) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for canon, counters in trie.terminals():
            if told_apart:
                rows += [(tbl, canon, form, least, n) for forms, least, n in _terminal_sets(counters) for form in forms]
            else:
                rows += [(tbl, canon, form, least, n) for form, (least, n) in counters.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], _COUNTED_NAMES)

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        trie = Trie()
        counters: dict = {}
        last = ("", "", "")
        for batch in parts:
            for tbl, bucket, canon, form, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tbl, bucket) != at:
                    if at:
                        yield from out(at[0], trie)
                    at, trie, last = (tbl, bucket), Trie(), ("", "", "")
                if (canon, form, key) == last:
                    continue  # delivered twice
                if canon != last[0]:
                    counters = trie.terminal(canon)
                last = (canon, form, key)
                count(counters, form, key, 1)
        if at:
            yield from out(at[0], trie)

    return op


def buckets(rows: DataFrame, limit: int = BUCKET, step: int = STEP, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (tbl, key, canon, ...) with ``bucket``, the shortest beginning of the canonical bytes
    whose bucket holds at most ``limit`` rows; and apart, if there are any, the rows of buckets that go
    on alike for ``deepest`` letters, theirs split by keys."""
    out = rows.withColumn("bucket", F.substring("canon", 1, step))
    sizes = lambda df: df.groupBy("tbl", "bucket").count().filter(F.col("count") > limit)
    over = landed(sizes(out), "copies-over")
    depth = step
    # a beginning shorter than the depth is all there is: it can't be split further
    while depth < deepest and not over.filter(F.length("bucket") >= depth).isEmpty():
        depth += step
        marked = out.join(over.select("tbl", "bucket", F.lit(True).alias("__over")), ["tbl", "bucket"], "left")
        out = marked.withColumn("bucket", F.when(F.col("__over"), F.substring("canon", 1, depth)).otherwise(F.col("bucket"))).drop("__over")
        over = landed(sizes(out), "copies-over")
    if over.isEmpty():
        return out, None
    parts = F.ceil(F.col("count") / limit).cast("int")
    split = out.join(over, ["tbl", "bucket"]).withColumn("bucket", F.concat_ws("\x1f", "bucket", F.pmod(F.xxhash64("key"), parts))).drop("count")
    return out.join(over, ["tbl", "bucket"], "left_anti"), split


def canonical_rows(df: DataFrame, tbl: str, key: str, columns: list[str], canon: Callable[..., tuple[str, str]]) -> DataFrame:
    """(tbl, key, canon, form) of each row that has letters or digits."""

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [canon(*row) for row in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)]
            kept = pa.array([bool(c) for c, _ in found], pa.bool_())
            cols = [pa.array([tbl] * len(found), pa.string()), batch.column(0), pa.array([c for c, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["tbl", "key", "canon", "form"]).filter(kept)

    picked = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("string") for c in columns])
    return picked.mapInArrow(op, "tbl string, key string, canon string, form string")


def _digests(df: DataFrame) -> DataFrame:
    """``df`` (canon, form) with 128 bits (g, h) that stand for both."""
    return df.withColumn("g", F.xxhash64("canon", "form")).withColumn("h", F.xxhash64(F.lit(1), "form", "canon"))


def copies(rows: DataFrame, limit: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The rows (tbl, key, g, h) and their forms' sets (tbl, g, h, least, n): n keys are copies of the one
    whose smallest key is ``least``."""
    rows = landed(_digests(rows), "copies-rows")
    whole, split = buckets(rows.select("tbl", "key", "canon", "form"), limit)
    order = ["tbl", "bucket", "canon", "form", "key"]
    ready = lambda df: df.select(*order).repartition("tbl", "bucket").sortWithinPartitions(*order)
    counted = ready(whole).mapInArrow(_count(True), _COUNTED)
    if split is not None:
        parts = ready(split).mapInArrow(_count(False), _COUNTED).groupBy("tbl", "canon", "form").agg(F.min("least").alias("least"), F.sum("n").alias("n"))

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            counters = {f: (k, n) for f, k, n in zip(pdf["form"], pdf["least"], pdf["n"], strict=True)}
            found = [(pdf["tbl"].iloc[0], pdf["canon"].iloc[0], form, least, n) for forms, least, n in _terminal_sets(counters) for form in forms]
            return pd.DataFrame(found, columns=_COUNTED_NAMES)

        counted = counted.unionByName(parts.groupBy("tbl", "canon").applyInPandas(together, _COUNTED))
    return rows.select("tbl", "key", "g", "h"), _digests(counted).select("tbl", "g", "h", "least", "n")


def pairs(rows: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(tbl, key_a, key_b): the smallest key of each set of copies with each other key.

    A set of a third of all rows is one counted group; its rows meet it in a
    join whose skewed partitions are split at run time."""
    members, counted = copies(rows, limit)
    several = counted.filter(F.col("n") > 1)
    out = members.join(several, ["tbl", "g", "h"]).filter(F.col("key") != F.col("least"))
    return out.select("tbl", F.col("least").alias("key_a"), F.col("key").alias("key_b")).distinct()


def collapsed(rows: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(tbl, key, n_copies): one row for each set of copies."""
    _, counted = copies(rows, limit)
    return counted.select("tbl", F.col("least").alias("key"), F.col("n").alias("n_copies")).distinct()
