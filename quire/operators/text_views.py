"""Views of running text: clean text, sentences, openers, rates, captions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ["e.g.", "i.e.", "cf.", "et al.", "vs.", "etc.", "Fig.", "Eq.", "Sec.", "Tab.", "Ref.", "Refs.", "Alg.", "App.", "approx.", "resp.", "Dr.", "Prof.", "Mr.", "Ms."]
# Stock connectives, verbs after a bare demonstrative, stock wrap-ups.
CONNECTIVES = ["furthermore", "moreover", "notably", "consequently", "additionally", "importantly", "therefore", "thus", "hence", "it is worth noting", "it should be noted"]
DEMONSTRATIVE_VERBS = [
    "shows", "show", "suggests", "suggest", "indicates", "indicate", "implies", "imply", "means", "demonstrates", "demonstrate", "highlights", "highlight",
    "allows", "allow", "enables", "enable", "results", "result", "leads", "lead", "confirms", "confirm", "reveals", "reveal", "proves", "prove",
]
WRAPUPS = [
    "together, these observations suggest", "together, these results suggest", "together, these results demonstrate", "these results highlight", "these findings highlight",
    "taken together, these findings", "taken together, these results", "this underscores", "these findings underscore", "this highlights the importance of",
    "these results suggest that", "these findings suggest that",
]


def clean_text(text: Column) -> Column:
    """Line-number lines dropped, words broken at a line's end joined, blank lines collapsed."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*[0-9]{1,4}\s*$"))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(\w)-\n(\w)", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, sentence, n_words, opener): sentences of 25 characters and four words or more.

    Blank lines end a sentence; a full stop, question or exclamation mark does
    before a capital, unless an abbreviation ends there: the parts are then one."""
    paragraphs = df.select(*keys, F.posexplode(F.split(clean_text(F.col(text)), r"\n\s*\n")).alias("para", "p"))
    parts = paragraphs.select(*keys, "para", F.posexplode(F.split(F.trim(F.regexp_replace("p", r"\s+", " ")), r"(?<=[.!?])\s+(?=[A-Z(\\$])")).alias("k", "s"))
    w = Window.partitionBy(*keys, "para").orderBy("k")
    ends = r"(?:^|[\s(])(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")$"
    starts = F.sum(F.when(F.coalesce(F.lag("s").over(w).rlike(ends), F.lit(False)), 0).otherwise(1)).over(w)
    merged = parts.withColumn("g", starts).groupBy(*keys, "para", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("sentence"))
    words = F.split("sentence", " ")
    plain = F.size(F.filter(words, lambda x: x.rlike(r"^\p{L}+$")))
    kept = merged.filter((F.length("sentence") >= 25) & (plain >= 4) & ~F.col("sentence").rlike(r"^(?:Figure|Fig\.|Table|Algorithm|Listing)\s+[A-Z]?[.0-9]+[:.]"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("para", "g"))
    return kept.select(*keys, pos.alias("pos"), "sentence", F.size(words).alias("n_words"), F.lower(F.regexp_extract("sentence", r"^\W*(\w+)", 1)).alias("opener"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def length_histogram(sent: DataFrame) -> DataFrame:
    """(bucket, n): sentence lengths in steps of ten words, open from fifty."""
    return sent.groupBy(F.least(F.floor(F.col("n_words") / 10) * 10, F.lit(50)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def longest(sent: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """The ``k`` longest sentences of each text (ties: the earlier), the feature of a report."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n_words"), "pos")
    return sent.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rate(sent: DataFrame, keys: list[str], words: list[str], least: int = 3, per: int = 1000, over: float = 3.0) -> DataFrame:
    """(keys, n, n_words, per_1000): texts whose sentences use some of the words often
    (each sentence counts once; quoted ones don't)."""
    has = F.lower("sentence").rlike(r"\b(?:" + "|".join(words) + r")\b")
    quoted = F.col("sentence").rlike('["“”‘’]')
    g = sent.groupBy(*keys).agg(F.sum(F.when(has & ~quoted, 1).otherwise(0)).alias("n"), F.sum("n_words").alias("n_words"))
    out = g.withColumn("per_1000", F.round(F.col("n") * per / F.col("n_words"), 4))
    return out.filter((F.col("n") >= least) & (F.col("per_1000") > over))


def percentage_claims(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, part, whole, claimed, off): "N of M (X%)" where X is off by more than 0.55 points."""
    rx = r"([0-9][0-9,]*) (?:of|out of) ([0-9][0-9,]*)[^.%]{0,40}?\(?([0-9]+(?:\.[0-9]+)?)\s*%"
    hits = df.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(rx), 0)).alias("hit"))
    num = lambda k: F.regexp_replace(F.regexp_extract("hit", rx, k), ",", "").try_cast("double")
    vals = hits.select(*keys, num(1).alias("part"), num(2).alias("whole"), num(3).alias("claimed")).filter("whole > 0 AND part <= whole")
    return vals.withColumn("off", F.round(F.abs(100 * F.col("part") / F.col("whole") - F.col("claimed")), 4)).filter("off > 0.55").distinct()


def definitions(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, uses, first_use, defined_at): short forms in capitals, where they
    are first used and where "Long Form (LF)" defines them."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z]{2,6})\b"), 1)
    defs = F.regexp_extract_all(F.col(text), F.lit(r"\(([A-Z]{2,6})\)"), 1)
    used = df.select(*keys, F.col(text).alias("__t"), F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("uses"), F.min("__t").alias("__t"))
    named = df.select(*keys, F.explode(defs).alias("token")).distinct().withColumn("defined", F.lit(True))
    out = used.join(named, [*keys, "token"], "left")
    return out.select(*keys, "token", "uses", F.expr("locate(token, __t)").alias("first_use"), F.when(F.col("defined"), F.expr("locate(concat('(', token, ')'), __t)")).alias("defined_at"))
