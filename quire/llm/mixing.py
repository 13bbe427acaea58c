"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer.  Each source's documents are put in a
shuffled order (by a hash) and cut into blocks of ``BLOCK`` tokens: a document
belongs to the block in which its running token count starts.  A mix is a
row of slots, one block each.  Slot i takes the point frac(i / golden ratio);
the cumulative target weights map it to a source, so every stretch of the
mix, not only the whole, is close to the target shares.  The r-th slot of a
source takes its block r modulo its number of blocks, as copy r div that number.

A mix is as long as its scarcest source allows: the least of repeats x tokens /
share.  Running counts and ranks are taken in two levels (within a part, over
the parts' totals), so that no task sees a whole source.

Defined results: sources without documents get nothing, and the others share
their weight in proportion (the report says so: reached 0); documents of a null
or unnamed source and those without tokens are in no mix; a document delivered
several times is one; a share of null or 0 or repeats below 1 give nothing; a mix
of nothing has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tokenize import count_tokens
from quire.session import landed

#: Tokens of a block; parts into which a source's order is cut for running counts; slots of a part.
BLOCK, PARTS, SLOT_PART = 1024, 256, 65_536
#: Rows of the targets at most (they are planned on the driver).
MAX_TARGETS = 10_000
# Fixed value: 2^32 / golden ratio.
_GOLDEN = 2_654_435_769


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that can be in a mix, counted once."""
    named = documents.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    counted = count_tokens(named.select("doc_id", "source", "text"), path=path).filter("n_tokens > 0")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*")
    return landed(one, "mix-sizes")


def blocks(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sizes`` with ``block`` and ``at``, the place in the source's shuffled order."""
    parts = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(17))).withColumn("part", F.pmod("h", F.lit(PARTS)))
    totals = parts.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = parts.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    at = F.col("offset") + F.col("inner")
    return run.join(offsets, ["source", "part"]).select("doc_id", "source", "n_tokens", at.alias("at"), F.floor(at / F.lit(block)).cast("long").alias("block"))


def _plan(sizes: DataFrame, targets: DataFrame, block: int) -> list[dict]:
    """Per mix: the number of slots and (source, weight, blocks, repeats) in order."""
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = targets.select("mix", "source", "target_share", "max_repeats").filter("mix IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
    rows = wanted.dropDuplicates(["mix", "source"]).join(totals, "source").orderBy("mix", "source").take(MAX_TARGETS + 1)
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    plans = []
    for mix in sorted({r.mix for r in rows}):
        own = [r for r in rows if r.mix == mix]
        whole = sum(r.target_share for r in own)
        weights = [r.target_share / whole for r in own]
        length = min(r.max_repeats * r.tokens / w for r, w in zip(own, weights, strict=True))
        plans.append({"mix": mix, "slots": int(length // block), "sources": [(r.source, w, -(-r.tokens // block), r.max_repeats) for r, w in zip(own, weights, strict=True)]})
    return plans


def schedule(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mix, slot, source, block, copy): which block of which source each slot takes."""
    spark = sizes.sparkSession
    out = None
    for p in _plan(sizes, targets, block):
        point = (F.col("slot") % (1 << 31) * _GOLDEN) % (1 << 32) / float(1 << 32)
        source = nb = repeats = None
        edge = 0.0
        for s, w, n, r in p["sources"]:
            edge += w
            test = point < edge
            source = F.when(test, s) if source is None else source.when(test, s)
            nb = F.when(F.col("source") == s, n) if nb is None else nb.when(F.col("source") == s, n)
            repeats = F.when(F.col("source") == s, r) if repeats is None else repeats.when(F.col("source") == s, r)
        last = p["sources"][-1][0]
        slots = spark.range(p["slots"]).select(F.lit(p["mix"]).alias("mix"), F.col("id").alias("slot")).withColumn("source", source.otherwise(last))
        slots = slots.withColumn("part", F.floor(F.col("slot") / SLOT_PART))
        counts = slots.groupBy("source", "part").count()
        before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1
        ranked = slots.withColumn("inner", rank).join(offsets, ["source", "part"]).withColumn("rank", F.col("offset") + F.col("inner"))
        ranked = ranked.withColumn("nb", nb.cast("long")).withColumn("copy", F.floor(F.col("rank") / F.col("nb")).cast("int")).filter(F.col("copy") < repeats)
        one = ranked.select("mix", "slot", "source", (F.col("rank") % F.col("nb")).alias("block"), "copy")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "mix string, slot long, source string, block long, copy int")
    return out


def mixed(documents: DataFrame, targets: DataFrame, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """(mix, slot, at, source, doc_id, copy, n_tokens): the mixes in order of
    slot, then at; copy counts a document's uses in the mix from 0."""
    sizes = sized(documents, path)
    placed = schedule(sizes, targets, block).join(blocks(sizes, block), ["source", "block"])
    return placed.select("mix", "slot", "at", "source", "doc_id", "copy", "n_tokens")


def reached(documents: DataFrame, targets: DataFrame, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """(mix, source, target_share, reached_share, n_tokens, n_rows, most_copies) of every target."""
    got = mixed(documents, targets, block, path).groupBy("mix", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), (F.max("copy") + 1).alias("most_copies"))
    wanted = targets.select("mix", "source", "target_share").dropDuplicates(["mix", "source"])
    out = wanted.join(got, ["mix", "source"], "left").fillna(0, ["n_tokens", "n_rows", "most_copies"])
    whole = F.sum("n_tokens").over(Window.partitionBy("mix"))
    return out.withColumn("reached_share", F.when(whole > 0, F.round(F.col("n_tokens") / whole, 6)).otherwise(F.lit(0.0)))
