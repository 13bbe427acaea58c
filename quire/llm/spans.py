"""Long exact spans shared between records (problem 9).

Fingerprints: every window of ``GRAM`` code points gets a polynomial hash (all
windows of a text at once, by prefix sums modulo 2^64); of every ``LEAST - GRAM
+ 1`` windows in a row the least hash is kept, so two texts with a stretch of
``LEAST`` code points in common keep a common hash inside it.

Copies: records of one text are one text to the index (its key a digest, taken
anew under another seed if two texts ever shared one), so that a text a third of
all records have is fingerprinted once a task and compared once.

Index: fingerprints live in sorted immutable runs, each a table of buckets of the
hash, sorted within.  A new batch is written as such a run and merge-joined with
the runs before it, bucket by bucket, without moving a row of theirs; hashes of two
or more texts come out.  Runs of a level are compacted into one of the next level
when there are ``fanout`` of them.  A manifest beside the runs names them, so that a
later job goes on where this one stopped.

Check: around each occurrence that came out, the code points that could matter
(``LEAST - GRAM`` on either side) are fetched from the text, and two
occurrences of a hash count only if their code points really agree over
``LEAST`` or more.  A hash with many records is checked in blocks of ``BLOCK``
by ``BLOCK`` records, each block a task's unit.

Defined results: null, empty and shorter texts share nothing; a stretch
repeated in one record only isn't shared; a repeated row of a record is the
same record; keys are 64-bit integers, a null key is no record; other columns
are ignored.  A run of a period under ``GRAM`` (a ruled line) is
fingerprinted at its first two and last two places, which finds every pair of
records: what another record shares with a run stands at its start too, a
number of periods before.  Shares and stretches take in all of the run that
stands a number of periods from what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import landed, scratch_path

#: Shortest stretch that counts, and the length of a fingerprinted window, in code points.
LEAST, GRAM = 200, 100
#: Records of one hash that are compared as one block.
BLOCK = 256
#: Batches in which the queries add the records: the third meets a compacted run.
BATCHES = 3
#: Texts that a task remembers so as to fingerprint copies once.
SEEN = 1_000_000

_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_B, _INV)):
            _POWERS[k] = np.cumprod(np.full(size, base, np.uint64))
    return _POWERS


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints_of(text: str, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of a text (as int64) and their places."""
    c = points(text)
    n = len(c)
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, q = _powers(n)
    s = np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[:n])
    h = s[gram - 1 :].copy()
    h[1:] -= s[: n - gram]
    h *= q[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    w, m = least - gram + 1, n - gram + 1
    full = np.concatenate([h, np.full(-m % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    head = np.minimum.accumulate(full, 1).ravel()
    tail = np.ascontiguousarray(np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1]).ravel()
    low = np.minimum(tail[: m - w + 1], head[w - 1 : m])  # the least of every w windows in a row
    # a window is kept if it is the least of some w in a row that hold it
    pad = np.full(w - 1, np.uint64(0))
    around = np.concatenate([pad, low, pad])
    k = len(around)
    full = np.concatenate([around, np.zeros(-k % w, np.uint64)]).reshape(-1, w)
    head = np.maximum.accumulate(full, 1).ravel()
    tail = np.ascontiguousarray(np.maximum.accumulate(full[:, ::-1], 1)[:, ::-1]).ravel()
    high = np.maximum(tail[:m], head[w - 1 : w - 1 + m])
    at = np.flatnonzero(h == high)
    kept = h[at]
    if len(np.unique(kept)) < len(kept):
        at = _without_periods(kept, at, gram)
        kept = h[at]
    return kept.view(np.int64), at


def _without_periods(h: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Of a hash's places that follow one another at one distance under ``gram``, the first two and the last two.

    Two runs of a period share most of their texts when they start at one place or a period apart, or end so."""
    order = np.lexsort((at, h))
    a, k = at[order], h[order]
    gap = a[1:] - a[:-1]
    same = (k[1:] == k[:-1]) & (gap < gram)
    even = np.zeros(len(a), bool)
    even[1:-1] = same[:-1] & same[1:] & (gap[:-1] == gap[1:])
    inner = np.zeros(len(a), bool)
    inner[1:-1] = even[:-2] & even[1:-1] & even[2:]
    return np.sort(a[~inner])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(fp, key, pos): the kept windows of every text; a task reads a key's text of one length once."""

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for pdf in parts:
            fresh = []
            for x in zip(pdf["key"].tolist(), pdf["text"].map(len).tolist(), strict=True):
                fresh.append(x not in seen)
                seen.add(x)
            if len(seen) > SEEN:
                seen.clear()
            pdf = pdf[fresh]
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                kept = [fingerprints_of(t, least, gram) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "fp": np.concatenate([h for h, _ in kept]) if kept else np.empty(0, np.int64),
                        "key": np.repeat(part["key"].to_numpy(np.int64), [len(h) for h, _ in kept]),
                        "pos": np.concatenate([a for _, a in kept]).astype(np.int32) if kept else np.empty(0, np.int32),
                    }
                )

    picked = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (F.length("text") >= least))
    return picked.mapInPandas(op, "fp long, key long, pos int")


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, (path or scratch_path(spark, "runs")).rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self._made = 0
        self._load()

    def _file_system(self, path: str):
        """The file system of a path, and the path in its terms."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _load(self) -> None:
        fs, at = self._file_system(self.path)
        if not fs.exists(at):
            return
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        whole = [n for n in names if n.startswith("manifest-") and fs.exists(self._file_system(f"{self.path}/{n}/_SUCCESS")[1])]
        if whole:
            rows = self.spark.read.schema("level int, path string, buckets int, made int").parquet(f"{self.path}/{max(whole, key=lambda n: int(n[9:]))}").collect()
            self.runs = sorted(((r.level, r.path) for r in rows), key=lambda x: (-x[0], x[1]))
            self.buckets, self._made = rows[0].buckets, rows[0].made

    def _save(self) -> None:
        """Name the runs in a new manifest; one that isn't whole is never read."""
        rows = [(k, p, self.buckets, self._made) for k, p in self.runs]
        self.spark.createDataFrame(rows, "level int, path string, buckets int, made int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self._made}")

    def _name(self, path: str) -> str:
        return f"quire_run_{hashlib.md5(path.encode()).hexdigest()}"

    def _write(self, level: int, fps: DataFrame) -> DataFrame:
        path = f"{self.path}/run-{level}-{self._made}"
        self._made += 1
        ready = fps.select("fp", "key", "pos").repartition(self.buckets, "fp")
        ready.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).option("compression", "zstd").mode("overwrite").saveAsTable(self._name(path))
        self.runs.append((level, path))
        return self.spark.table(self._name(path))

    def _read(self, path: str) -> DataFrame:
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, key BIGINT, pos INT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def history(self) -> DataFrame | None:
        """All fingerprints of the runs so far."""
        out = None
        for _, path in self.runs:
            out = self._read(path) if out is None else out.unionByName(self._read(path))
        return out

    def add(self, fps: DataFrame) -> DataFrame:
        """Add a batch (fp, key, pos); the occurrences of the hashes it shares, in itself or with a run.

        The batch is a sorted run before anything is compared with it, so a
        lost executor costs a re-read, no re-hashing."""
        before = [self._read(p) for _, p in self.runs]
        new = self._write(0, fps)
        several = new.groupBy("fp").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("fp")
        out = new.join(several, "fp", "left_semi")
        for run in before:  # buckets meet buckets, in their order
            out = out.unionByName(new.hint("merge").join(run.select("fp").hint("merge"), "fp", "left_semi"))
            out = out.unionByName(run.hint("merge").join(new.select("fp").hint("merge"), "fp", "left_semi"))
        found = landed(out, "spans-shared")
        self._save()
        return found

    def compact(self) -> None:
        """Merge the runs of each level that has ``fanout`` of them into one of the next level."""
        level, gone = 0, []
        while level <= max((k for k, _ in self.runs), default=-1):
            old = [r for r in self.runs if r[0] == level]
            if len(old) >= self.fanout:
                merged = self._read(old[0][1])
                for _, p in old[1:]:
                    merged = merged.unionByName(self._read(p))
                self._write(level + 1, merged)
                self.runs = [r for r in self.runs if r[0] != level]
                gone += old
            level += 1
        if gone:
            self._save()
            for _, p in gone:
                self._drop(p)
                fs, at = self._file_system(p)
                fs.delete(at, True)

    def _drop(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")

    def close(self) -> None:
        """Forget the runs' names in this session; the folder stays."""
        for _, p in self.runs:
            self._drop(p)


def _texts(df: DataFrame, key: str, text: str, least: int, seed: int) -> DataFrame:
    """(key, dig, text) of the records long enough to share anything."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (F.length("text") >= least))
    return rows.withColumn("dig", F.xxhash64(F.lit(seed), "text"))


def _members(df: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, int]:
    """(key, dig, n): each record and the digest of its text, under a seed by which no two texts share one."""
    seed = 0
    while True:
        rows = _texts(df, key, text, least, seed)
        out = landed(rows.select("key", "dig", F.xxhash64(F.lit(-1 - seed), "text").alias("other"), F.length("text").alias("n")).distinct(), "spans-members")
        if out.groupBy("dig").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi").isEmpty():
            return out.drop("other"), seed
        seed += 1


def _run(text: str, first: int, second: int, gram: int) -> tuple[int, int, int]:
    """(start, end, period) of the run of the period ``second - first`` in which the windows at both places lie; zeros if they aren't equal."""
    period = second - first
    c = points(text)
    same = c[:-period] == c[period:]
    if not same[first : first + gram].all():
        return 0, 0, 0
    before, after = np.flatnonzero(~same[:first]), np.flatnonzero(~same[first:])
    start = int(before[-1]) + 1 if len(before) else 0
    return start, (first + int(after[0]) if len(after) else len(same)) + period, period


def _runs(text: str, fps: list[int], places: list[int], gram: int) -> list[tuple[int, int, int]]:
    """The run of a period under ``gram`` in which each occurrence lies, zeros for none."""
    out = [(0, 0, 0)] * len(places)
    order = sorted(range(len(places)), key=lambda i: (fps[i], places[i]))
    for i, j in zip(order, order[1:], strict=False):
        if fps[i] == fps[j] and places[j] - places[i] < gram:
            run = out[i] if out[i][2] == places[j] - places[i] else _run(text, places[i], places[j], gram)
            if run[2]:
                out[i] = out[i] if out[i][2] else run
                out[j] = run
    return out


def _contexts(occurrences: DataFrame, members: DataFrame, texts: DataFrame, least: int, gram: int, intervals: bool) -> DataFrame:
    """(fp, key, pos, start, ctx): the code points that matter around each occurrence, ``key`` the digest; for ``intervals``
    the run (lo, hi, period) too in which it lies."""
    side = least - gram
    lists = occurrences.groupBy(F.col("key").alias("dig")).agg(F.collect_set(F.struct("fp", "pos")).alias("at"))
    first = members.groupBy("dig").agg(F.min("key").alias("key"))
    ready = lists.join(first, "dig").join(texts, ["key", "dig"]).select("dig", "text", F.col("at.fp").alias("fps"), F.col("at.pos").alias("places"))

    def op(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                dig, text, fps, places = (batch.column(k)[i] for k in range(4))
                t, ps = text.as_py(), places.as_py()
                starts = [max(p - side - 1, 0) for p in ps]
                cut = [t[s : p + gram + side] for s, p in zip(starts, ps, strict=True)]
                out = [fps.values, pa.array([dig.as_py()] * len(ps), pa.int64()), pa.array(ps, pa.int32()), pa.array(starts, pa.int32()), pa.array(cut, pa.string())]
                if intervals:
                    out += [pa.array(x, pa.int32()) for x in zip(*_runs(t, fps.as_py(), ps, gram), strict=True)]
                yield pa.RecordBatch.from_arrays(out, ["fp", "key", "pos", "start", "ctx", *(["lo", "hi", "period"] if intervals else [])])

    return ready.mapInArrow(op, "fp long, key long, pos int, start int, ctx string" + (", lo int, hi int, period int" if intervals else ""))


def _widened(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, period: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches with all that repeats their part of a run (lo, hi) by its period: ``least`` of it stand there as often as it fits."""
    a, b, p = np.maximum(start, lo), np.minimum(end, hi), np.maximum(period, 1)
    inside = (period > 0) & (b - a >= least)
    left, right = a - (a - lo) // p * p, b + (hi - b) // p * p
    return np.where(inside, np.minimum(start, left), start), np.where(inside, np.maximum(end, right), end)


def _blocks(ctx: DataFrame) -> DataFrame:
    """Each occurrence once for every pair of blocks of its hash that it is in."""
    n = Window.partitionBy("fp")
    sized = ctx.withColumn("m", F.ceil(F.count("*").over(n) / F.lit(BLOCK)).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("key", "pos"), F.col("m")).cast("int"))
    other = sized.withColumn("x", F.explode(F.expr("sequence(0, m - 1)")))
    return other.withColumn("bi", F.least("own", "x")).withColumn("bj", F.greatest("own", "x")).drop("x", "m")


def _verify(least: int, gram: int, intervals: bool):
    """The check of one block pair, as a function of sorted batches."""
    side = least - gram

    def block(fp: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
        n = len(fp)
        key = fp["key"].to_numpy(np.int64)
        if n < 2 or (key == key[0]).all():
            return []
        off = (fp["pos"] - fp["start"]).to_numpy(np.int64)
        wide = np.empty((n, 2 * side + 1 + gram), np.uint32)
        wide[:] = (0x110000 + np.arange(n, dtype=np.uint32))[:, None]
        for i, (text, o) in enumerate(zip(fp["ctx"], off, strict=True)):
            c = points(text)
            wide[i, side + 1 - o : side + 1 - o + len(c)] = c
        left = np.ascontiguousarray(wide[:, side::-1])  # nearest first, side + 1 of them
        middle, right = wide[:, side + 1 : side + 1 + gram], wide[:, side + 1 + gram :]
        own, bi, bj = fp["own"].to_numpy(), fp["bi"].iloc[0], fp["bj"].iloc[0]
        out = []
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            ok = key[rest] != key[i]
            if bi != bj:
                ok &= own[rest] != own[i]
            rest = rest[ok]
            if not len(rest):
                continue
            rest = rest[(middle[rest] == middle[i]).all(1)]
            le = np.cumprod(left[rest] == left[i], 1, dtype=np.int8).sum(1, dtype=np.int64)
            ri = np.cumprod(right[rest] == right[i], 1, dtype=np.int8).sum(1, dtype=np.int64)
            long = np.minimum(le, side) + gram + ri >= least
            rest, le, ri = rest[long], le[long], ri[long]
            if intervals:
                if len(rest):
                    pos = fp["pos"].to_numpy(np.int64)
                    start, end = np.append(pos[rest] - np.minimum(le, side), pos[i] - min(side, le.max())), np.append(pos[rest] + gram + ri, pos[i] + gram + ri.max())
                    both = np.append(rest, i)
                    out.append((key[both], *_widened(start, end, *(fp[c].to_numpy(np.int64)[both] for c in ("lo", "hi", "period")), least)))
            else:
                first = le <= side  # further right in a stretch, the hashes before it tell of the pair
                rest = rest[first]
                if len(rest):
                    out.append((np.minimum(key[rest], key[i]), np.maximum(key[rest], key[i])))
        return out

    names = ["key", "start", "end"] if intervals else ["doc_id_a", "doc_id_b"]

    def op(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in parts:
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None and len(held) else pdf
            if not len(pdf):
                continue
            ids = pdf[["fp", "bi", "bj"]].to_numpy(np.int64)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            last = cuts[-1] if len(cuts) else 0
            held = pdf.iloc[last:]
            yield from done(pdf, cuts)
        if held is not None and len(held):
            yield from done(held, np.array([len(held)]))

    def done(pdf: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        found, a = [], 0
        for b in cuts:
            found += block(pdf.iloc[a:b])
            a = b
        if found:
            yield pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(names)}).drop_duplicates()

    return op


def _checked(df: DataFrame, key: str, text: str, batches: int, least: int, gram: int, intervals: bool) -> tuple[DataFrame, DataFrame]:
    """What the check finds, by digests, and the records (key, dig, n)."""
    members, seed = _members(df, key, text, least)
    texts = _texts(df, key, text, least, seed)
    index = FingerprintIndex(df.sparkSession)
    shared = None
    for b in range(batches):
        found = index.add(fingerprints(texts.filter(F.pmod(F.col("dig"), F.lit(batches)) == b), "dig", "text", least, gram))
        index.compact()
        shared = found if shared is None else shared.unionByName(found)
    index.close()
    assert shared is not None
    ctx = _blocks(_contexts(shared, members, texts, least, gram, intervals))
    ready = ctx.repartition("fp", "bi", "bj").sortWithinPartitions("fp", "bi", "bj")
    schema = "key long, start long, end long" if intervals else "doc_id_a long, doc_id_b long"
    return ready.mapInPandas(_verify(least, gram, intervals), schema).distinct(), members


def pairs(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id_a, doc_id_b) of the records that share a stretch of ``least`` code points."""
    found, members = _checked(df, key, text, batches, least, gram, False)
    a = members.select(F.col("dig").alias("doc_id_a"), F.col("key").alias("ka"))
    b = members.select(F.col("dig").alias("doc_id_b"), F.col("key").alias("kb"))
    across = found.join(a, "doc_id_a").join(b, "doc_id_b").filter("ka <> kb").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    several = members.groupBy("dig").count().filter("count > 1").select("dig")
    same = members.join(several, "dig").select("dig", F.col("key").alias("ka"))
    copies = same.join(same.withColumnRenamed("ka", "kb"), "dig").filter("ka < kb").select("ka", "kb")
    return across.unionByName(copies).distinct().select(F.col("ka").alias("doc_id_a"), F.col("kb").alias("doc_id_b"))


def _intervals(df: DataFrame, key: str, text: str, batches: int, least: int, gram: int) -> DataFrame:
    """(key, start, end): parts of records that stand in others too; of a text that several records have, all of it."""
    found, members = _checked(df, key, text, batches, least, gram, True)
    parts = found.withColumnRenamed("key", "dig").join(members, "dig").select("key", "start", "end")
    several = members.groupBy("dig").count().filter("count > 1").select("dig")
    whole = members.join(several, "dig").select("key", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    return parts.unionByName(whole).distinct()


def shares(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every record: how much of its text
    lies in stretches that stand in others too (0 for those that share none)."""
    found = _intervals(df, key, text, batches, least, gram)
    row = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    covered = found.withColumn("added", added).groupBy("key").agg(F.sum("added").alias("shared_chars"))
    all_ = df.select(F.col(key).alias("key"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")).filter(F.col("key").isNotNull()).distinct()
    share = F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0))
    out = all_.join(covered, "key", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("share", share).withColumnRenamed("key", key)


def stretches(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(key, start, end): the parts of each record that stand in others too, joined where they touch."""
    found = _intervals(df, key, text, batches, least, gram)
    row = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.when(F.col("start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(row))
    return marked.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island").withColumnRenamed("key", key)
