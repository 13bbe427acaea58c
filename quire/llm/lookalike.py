"""One consistent form for text that looks the same (problem 4).

Texts are exploded to positioned units: a run of ASCII letters, a run of other
ASCII (fixed points of every mapping, so a run travels as one unit) or one
other code point.  Units meet the decomposition table by a broadcast join (its
size is bounded by Unicode), which gives zero or more pieces with a combining
class each.  Words are then runs of letters between pieces that are none; in a
word that holds a Latin letter the look-alike table (broadcast, under a hundred
rows) maps Cyrillic, Greek and other letters of the same looks.  Marks are
ordered by class after their starter, the string is rebuilt and recomposed.

What changes: full-width, narrow and mathematical letters and digits,
ligatures, marks set apart from their letters, spaces of other widths, characters
without any looks, and look-alikes inside Latin words.  What stays: case,
typographic quotes and dashes, lone Greek symbols, words wholly of another
script, Han text's own wide punctuation, emoji joiners.

Defined results: a null text stays null, an empty one empty; a text of ASCII
alone is its own form; equal texts have equal forms, and the form of a form is
itself; a break mark (soft hyphen) at a text's end stays and is not odd; the
extra columns of a table pass through under their names.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "І": "I", "ј": "j", "Ј": "J", "ѕ": "s", "Ѕ": "S",
    "һ": "h", "Һ": "H", "ԁ": "d", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W", "ѵ": "v", "Ѵ": "V", "ӏ": "l", "Ӏ": "I", "Ү": "Y", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S",
}
#: Code points without looks (zero-width, joiners, direction marks, soft hyphen, fillers).
HIDDEN = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ﻿ﾠ"
#: Compatibility kinds whose looks stay the same.
_SAME_LOOKS = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def _expand(ch: str) -> str | None:
    """What a code point decomposes to, None where it stays as it is."""
    if ch in HIDDEN or 0xE0000 <= ord(ch) <= 0xE007F:
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    kind, _, _ = unicodedata.decomposition(ch).partition(" ")
    if kind in _SAME_LOOKS or 0xFB00 <= ord(ch) <= 0xFB06:
        return unicodedata.normalize("NFKD", ch)
    if kind and kind[0] != "<":
        return unicodedata.normalize("NFD", ch)
    return None


def _script(ch: str) -> int:
    """2: a Latin letter, 1: another letter or mark, 0: no part of a word."""
    c = unicodedata.category(ch)
    if c[0] == "M":
        return 1
    return 0 if c[0] != "L" else 2 if "LATIN" in unicodedata.name(ch, "") else 1


def _is_apart(ch: str) -> bool:
    o = ord(ch)
    return 0x300 <= o <= 0x36F or 0x1AB0 <= o <= 0x1AFF or 0x1DC0 <= o <= 0x1DFF or 0x20D0 <= o <= 0x20FF or 0xFE20 <= o <= 0xFE2F


@functools.lru_cache(1)
def _rules() -> pd.DataFrame:
    """unit, k, piece, ccc, script, odd: how each code point outside ASCII comes apart."""
    rows = []
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF or 0xE000 <= o <= 0xF8FF or o >= 0xF0000:
            continue
        to = _expand(ch)
        category = unicodedata.category(ch)
        if to is None and category[0] not in "LM":
            continue
        if to is None and 0x2E80 <= o and category == "Lo":
            continue  # Han and other large blocks are letters by default
        apart = _is_apart(ch)
        changed = to is not None and (to == "" or not unicodedata.decomposition(ch) or unicodedata.decomposition(ch)[0] == "<")
        odd = 2 if changed and category[0] == "P" and o >= 0xFF00 else 1 if apart or changed else 0
        for k, piece in enumerate(to if to else [""] if to == "" else [ch]):
            rows.append((ch, k, piece, unicodedata.combining(piece) if piece else 0, _script(piece) if piece else -1, odd))
    return pd.DataFrame(rows, columns=["unit", "k", "piece", "ccc", "script", "odd"])


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rules = spark.createDataFrame(_rules(), "unit string, k int, piece string, ccc int, script int, odd int")
    rules = rules.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("k", "piece", "ccc", "script", "odd"))).alias("pieces"))
    looks = spark.createDataFrame(sorted(LOOKALIKES.items()), "piece string, look string")
    return F.broadcast(rules), F.broadcast(looks)


@F.pandas_udf(T.StringType())
def _compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x))


ODD_TEXT = r"[^\x00-\x7F]"


def forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, text, form, is_odd) of the distinct texts that hold other than ASCII.

    h1, h2 are hashes of the text; is_odd tells that the text holds a character
    that a reader takes for another one or does not see."""
    rules, looks = _tables(texts.sparkSession)
    base = texts.select(F.col(text).alias("text")).filter(F.col("text").rlike(ODD_TEXT)).distinct()
    # what depends on a whole text is worked out once a text, and the text itself goes with its first unit alone
    split = r"regexp_extract_all({}, '[A-Za-z]+|[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[^\\x00-\\x7F]', 0)"
    ends = F.col("text").rlike("­\\s*$")
    known = base.select(
        F.xxhash64("text").alias("h1"),
        F.hash("text").alias("h2"),
        F.col("text").rlike(r"\p{IsHan}").alias("han"),
        F.when(ends, F.size(F.expr(split.format("rtrim(text)"))) - 1).alias("broken"),
        F.transform(F.expr(split.format("text")), lambda u, i: F.struct(i.alias("pos"), u.alias("unit"), F.when(i == 0, F.col("text")).alias("text"))).alias("units"),
    )
    units = known.select("h1", "h2", "han", "broken", F.explode("units").alias("u")).select("h1", "h2", "han", "broken", "u.*")
    letters = F.col("unit").rlike("^[A-Za-z]")
    plain = F.array(
        F.struct(
            F.lit(0).alias("k"),
            F.col("unit").alias("piece"),
            F.lit(0).alias("ccc"),
            F.when(letters, 2).when(F.col("unit").rlike(r"^[^\x00-\x7F]$") & F.col("unit").rlike(r"\p{L}"), 1).otherwise(0).alias("script"),
            F.lit(0).alias("odd"),
        )
    )
    at_end = (F.col("unit") == "­") & (F.col("pos") > 0) & F.coalesce(F.col("pos") >= F.col("broken"), F.lit(False))
    pieces = (
        units.join(rules, "unit", "left")
        .withColumn("pieces", F.when(at_end, plain).otherwise(F.coalesce("pieces", plain)))
        .select("h1", "h2", "pos", "text", "han", F.explode("pieces").alias("p"))
        .select("h1", "h2", "pos", "text", "han", "p.*")
        .join(looks, "piece", "left")
    )
    row = Window.partitionBy("h1", "h2")
    run = row.orderBy("pos", "k")
    marked = pieces.withColumn("word", F.sum(F.when(F.col("script") == 0, 1).otherwise(0)).over(run)).withColumn(
        "starter", F.sum(F.when((F.col("ccc") == 0) & (F.col("script") >= 0), 1).otherwise(0)).over(run)
    )
    latin = F.max(F.when(F.col("script") == 2, 1).otherwise(0)).over(Window.partitionBy("h1", "h2", "word"))
    # a look-alike of a Latin letter that is itself Latin (script g, alpha) has its word's other letters beside it
    words = marked.withColumn("latin", latin)
    mapped = F.col("look").isNotNull() & (F.col("latin") == 1) & (F.col("script") > 0)
    done = words.select(
        "h1",
        "h2",
        "text",
        F.struct("starter", "ccc", "pos", "k", F.when(mapped, F.col("look")).otherwise(F.col("piece")).alias("s")).alias("x"),
        (mapped | (F.col("odd") == 1) | ((F.col("odd") == 2) & ~F.col("han"))).alias("odd"),
    )
    out = done.groupBy("h1", "h2").agg(F.max("text").alias("text"), F.array_sort(F.collect_list("x")).alias("xs"), F.max("odd").alias("is_odd"))
    return out.select("h1", "h2", "text", _compose(F.concat_ws("", F.col("xs.s"))).alias("form"), "is_odd")


def normalise(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` with its text's consistent form as column ``out``.

    Texts of ASCII alone don't leave their row; the rest join the forms of the
    distinct texts by hash."""
    f = forms(df, text).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("form").alias("__form"))
    other = F.col(text).rlike(ODD_TEXT)
    keyed = df.withColumn("__h1", F.when(other, F.xxhash64(text))).withColumn("__h2", F.when(other, F.hash(text)))
    return keyed.join(f, ["__h1", "__h2"], "left").withColumn(out, F.coalesce("__form", F.col(text))).drop("__h1", "__h2", "__form")


def found(rows: DataFrame) -> DataFrame:
    """(tbl, row_key) of the rows (tbl, row_key, text) whose text is odd."""
    odd = rows.filter(F.col("text").rlike(ODD_TEXT)).distinct()
    keyed = odd.select("tbl", "row_key", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    cases = forms(odd).filter("is_odd").select("h1", "h2")
    return keyed.join(cases, ["h1", "h2"], "left_semi").select("tbl", "row_key").distinct()
