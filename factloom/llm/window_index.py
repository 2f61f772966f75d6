"""Incremental substring deduplication over a log-structured fingerprint index.

A window is ``width`` consecutive words. Of the word grams inside a window (half its width), the
one with the smallest hash is its fingerprint, so equal windows have equal fingerprints and
neighbouring windows mostly share one: a text is a sequence of stretches, runs of windows with one
fingerprint. The index holds each different stretch (its fingerprint, the hash of its words, the first
document it was seen in) in immutable runs, bucketed and sorted by fingerprint, in a folder
that a later session opens again:

* a batch of newer documents becomes a run; the run is merge-joined with the older runs (same
  buckets, so nothing is shuffled) to find the fingerprints that history already holds;
* a stretch seen before, word for word, is a repeat. Stretches that share only the fingerprint are
  verified window by window: the windows of both are taken from their texts; of history, only the documents
  that such stretches were first seen in are read;
* as many runs of one tier as ``fan_in`` are compacted into one of the next tier, so a row is
  written once a tier.

Stretches are counted once however often they occur, so a passage or a copy that fills a third of
the corpus is compared once; each document then joins the verdicts of its stretches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.shared import forget, settle, shared_dir, small_batches, spread

WIDTH = 50
#: Bytes of text hashed at once. A worker's hashes, sums and powers are some seventy times as large.
CHUNK = 1 << 18
_MARKS = "id long, tk long, n_words long, sha binary, prints array<long>, contents array<long>"


class Stretch(NamedTuple):
    """Consecutive windows of one text with the same fingerprint occurrence."""

    first: np.ndarray
    count: np.ndarray
    mark: np.ndarray


def stretches(h: np.ndarray, width: int) -> Stretch:
    gram = width // 2
    marks = T.grams(h, gram)
    at = T.sliding_argmin(marks, width - gram + 1)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Stretch(none, none, np.zeros(0, T.U))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return Stretch(first, np.diff(np.append(first, len(at))), marks[at[first]])


def _contents(w: np.ndarray, s: Stretch, width: int) -> np.ndarray:
    """Hash of all words w under each stretch."""
    n = len(w)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, T.U)
        np.cumsum(w * T.powers(int(T._P), n)[:n], out=sums[1:])
        end = s.first + s.count + width - 1
        return T.mix((sums[end] - sums[s.first]) * T.powers(T.inverse(int(T._P)), n)[s.first] ^ s.count.astype(T.U))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _mark(width: int):
    """Per document: its words, the digest of all of them, and its different stretches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in T.parts(b.column("text"), CHUNK):
                words = T.Words(raw, off)
                h, h1 = words.hashes(), words.hashes(1)
                data = raw.tobytes()
                prints, contents = [], []
                for a, z in zip(words.off[:-1], words.off[1:], strict=True):
                    s = stretches(h[a:z], width)
                    ck = _contents(h1[a:z], s, width)
                    one = np.unique(T.mix(s.mark) ^ ck, return_index=True)[1]
                    prints.append(s.mark[one])
                    contents.append(ck[one])
                shas = [hashlib.sha256(b" ".join(data[a:z].split())).digest() for a, z in zip(off[:-1], off[1:], strict=True)]
                part = b.slice(i, j - i)
                yield pa.record_batch([part.column("id"), part.column("tk"), pa.array(np.diff(words.off)), pa.array(shas, pa.binary()), _lists(prints), _lists(contents)], names=["id", "tk", "n_words", "sha", "prints", "contents"])

    return run


def _windows(width: int):
    """Rows (id, text, wanted stretches (h, ck)) -> the hashes of each one's windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column("want")
            for i, j, raw, off in T.parts(b.column("text"), CHUNK):
                words = T.Words(raw, off)
                h, h1 = words.hashes(), words.hashes(1)
                rows: list[tuple] = []
                for k in range(j - i):
                    a, z = words.off[k], words.off[k + 1]
                    wanted = {(x["h"], x["ck"]) for x in want[i + k].as_py()}
                    s = stretches(h[a:z], width)
                    near = np.flatnonzero(np.isin(s.mark.view(np.int64), [x[0] for x in wanted]))
                    s = Stretch(s.first[near], s.count[near], s.mark[near])
                    ck = _contents(h1[a:z], s, width).view(np.int64).tolist()
                    w = T.grams(h1[a:z], width).view(np.int64)
                    for first, count, key in zip(s.first.tolist(), s.count.tolist(), zip(s.mark.view(np.int64).tolist(), ck, strict=True), strict=True):
                        if key in wanted:
                            wanted.discard(key)
                            rows.append((*key, w[first : first + count].tolist()))
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["h", "ck", "windows"])

    return run


def _finish(width: int):
    """Rows (id, tk, text, removed array<struct<h, ck, at>>; at: windows, null for all) -> counts and digest of what stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            found = b.column("removed")
            for i, j, raw, off in T.parts(b.column("text"), CHUNK):
                words = T.Words(raw, off)
                h, h1 = words.hashes(), words.hashes(1)
                data = raw.tobytes()
                for k in range(j - i):
                    a, z = words.off[k], words.off[k + 1]
                    gone = {(r["h"], r["ck"]): r["at"] for r in found[i + k].as_py()}
                    s = stretches(h[a:z], width)
                    near = np.flatnonzero(np.isin(s.mark.view(np.int64), [x[0] for x in gone]))
                    s = Stretch(s.first[near], s.count[near], s.mark[near])
                    ck = _contents(h1[a:z], s, width).view(np.int64).tolist()
                    edge = np.zeros(z - a + 1, np.int64)
                    for first, count, key in zip(s.first.tolist(), s.count.tolist(), zip(s.mark.view(np.int64).tolist(), ck, strict=True), strict=True):
                        if key in gone:
                            at = first + (np.arange(count) if gone[key] is None else np.asarray(gone[key], np.int64))
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + width, -1)
                    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + a
                    kept = b" ".join([data[x:y] for x, y in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                    rows.append((b.column("id")[i + k].as_py(), b.column("tk")[i + k].as_py(), z - a - len(keep), hashlib.sha256(kept).digest(), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "tk", "n_removed", "cut_sha", "kept"])

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, tk): tk tells rows that repeat an id with another text apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    return rows.withColumn("tk", F.xxhash64("text"))


class WindowIndex:
    """Log-structured index: immutable runs (h, ck, first, last) in tiers, bucketed and sorted by h, in one shared folder.

    Another session goes on where one ended: ``WindowIndex(spark, path)`` opens what lies there. A run counts
    once it is complete, and runs replaced by a compaction may be left over by a lost driver: they say nothing new.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, buckets: int | None = None, fan_in: int = 2):
        small_batches(spark)
        self.spark, self.width, self.fan_in = spark, width, fan_in
        self.path = path or f"{shared_dir(spark)}/factloom-index-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str, str]] = []  # tier, table, folder
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = jvm.org.apache.hadoop.fs.Path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = self._fs.listStatus(self._at(self.path)) if self._fs.exists(self._at(self.path)) else []
        for status in found:
            name = status.getPath().getName()
            kind, tier, width, buckets, _ = name.split("-")
            if kind == "run" and self._fs.exists(self._at(f"{self.path}/{name}/_SUCCESS")):
                if int(width) != self.width:
                    raise ValueError(f"the index holds windows of {width} words")
                self.buckets = int(buckets)
                self._register(int(tier), name)

    def _register(self, tier: int, name: str) -> None:
        table, at = f"factloom_{name.replace('-', '_')}", f"{self.path}/{name}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (h BIGINT, ck BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        self.runs.append((tier, table, at))

    def _write(self, rows: DataFrame, tier: int) -> None:
        """rows (h, ck, first, last) become a run."""
        name = f"run-{tier}-{self.width}-{self.buckets}-{uuid.uuid4().hex}"
        table = f"factloom_{name.replace('-', '_')}"
        dealt = rows.select("h", "ck", "first", "last").repartition(self.buckets, "h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.runs.append((tier, table, f"{self.path}/{name}"))

    def _drop(self, runs: list[tuple[int, str, str]]) -> None:
        for run in runs:
            self.runs.remove(run)
            self.spark.sql(f"DROP TABLE IF EXISTS {run[1]}")
            self._fs.delete(self._at(run[2]), True)

    def compact(self) -> None:
        """Merge the runs of a tier that has ``fan_in`` of them into one of the next; the old ones go after it is written."""
        tier = 0
        while any(t >= tier for t, *_ in self.runs):
            old = [r for r in self.runs if r[0] == tier]
            if len(old) >= self.fan_in:
                rows = self.spark.table(old[0][1])
                for r in old[1:]:
                    rows = rows.union(self.spark.table(r[1]))
                self._write(rows.groupBy("h", "ck").agg(F.min("first").alias("first"), F.max("last").alias("last")), tier + 1)
                self._drop(old)
            tier += 1

    def close(self, delete: bool = False) -> None:
        """Forget the tables of this session; delete: the index itself, too."""
        for _, table, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # outside the warehouse: the files stay
        self.runs = []
        if delete:
            self._fs.delete(self._at(self.path), True)

    def add(self, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
        """Judge ``docs``, all with larger ids than before, against history and each other, and add them.

        Returns (id, tk, n_words, sha, n_removed, cut_sha, kept) by row. history: the documents added
        before; only those are taken from it that first held a stretch to be verified.
        """
        source = _source(docs, id_col, text_col)
        marks = settle(spread(source).mapInArrow(_mark(self.width), _MARKS), "marks")
        pairs = marks.select("id", "tk", F.explode(F.arrays_zip("prints", "contents")).alias("s")).select("id", "tk", F.col("s.prints").alias("h"), F.col("s.contents").alias("ck"))
        old = [self.spark.table(table) for _, table, _ in self.runs]
        self._write(pairs.groupBy("h", "ck").agg(F.min("id").alias("first"), F.max("id").alias("last")), 0)
        new = self.spark.table(self.runs[-1][1])

        met = [new.groupBy("h").agg(F.min("first").alias("a"), F.max("last").alias("z")).filter("a < z").select("h")]
        met += [new.select("h").join(o.select("h").hint("merge"), "h", "left_semi") for o in old]
        hits = met[0]
        for m in met[1:]:
            hits = hits.union(m)
        hits = settle(hits.distinct(), "hits")
        # each run is filtered inside its buckets, before runs meet in a shuffle
        of_run = lambda run, fresh: run.join(hits.hint("merge"), "h", "left_semi").select("h", "ck", "first", "last", F.lit(fresh).alias("new"))
        seen = of_run(new, True)
        for o in old:
            seen = seen.union(of_run(o, False))
        kinds = seen.groupBy("h", "ck").agg(F.min("first").alias("first_id"), F.max(F.when(F.col("new"), F.col("last"))).alias("last_id"), F.min("new").alias("fresh"))
        kinds = settle(kinds, "kinds")
        # verified window by window: fingerprints of a stretch that is new, with another one in an earlier document
        open_marks = kinds.groupBy("h").agg(F.min("first_id").alias("a"), F.max(F.when(F.col("fresh"), F.col("first_id"))).alias("z")).filter("a < z").select("h")
        wanted = kinds.join(settle(open_marks, "open"), "h", "left_semi")  # settled, so that AQE can split a hot fingerprint
        wanted = settle(wanted, "wanted")
        asked = wanted.groupBy(F.col("first_id").alias("id")).agg(F.collect_list(F.struct("h", "ck")).alias("want"))
        texts = source.select("id", "text")
        if history is not None:
            texts = texts.union(_source(history, id_col, text_col).select("id", "text"))
        windows = texts.join(asked, "id").mapInArrow(_windows(self.width), "h long, ck long, windows array<long>")
        windows = windows.groupBy("h", "ck").agg(F.any_value("windows").alias("windows"))
        each = settle(windows.join(wanted, ["h", "ck"]).select("h", "ck", "first_id", "fresh", F.posexplode("windows").alias("at", "w")), "each")
        least = each.groupBy("h", "w").agg(F.min("first_id").alias("least"), F.max("first_id").alias("most")).filter("least < most").select("h", "w", "least")
        again = each.filter("fresh").join(least, ["h", "w"]).filter("least < first_id").groupBy("h", "ck").agg(F.collect_set("at").alias("at"))
        verdicts = kinds.filter("last_id is not null").select("h", "ck", "first_id", "last_id").join(again, ["h", "ck"], "left").filter("last_id > first_id or at is not null").drop("last_id")
        verdicts = settle(verdicts, "verdicts")  # so that the join below is one that AQE can split where a stretch is hot
        removed = pairs.join(verdicts, ["h", "ck"]).filter("id > first_id or at is not null")
        whole = F.when(F.col("id") == F.col("first_id"), F.col("at"))
        removed = removed.groupBy("id", "tk").agg(F.collect_list(F.struct("h", "ck", whole.alias("at"))).alias("removed"))
        cut = source.join(removed, ["id", "tk"]).mapInArrow(_finish(self.width), "id long, tk long, n_removed long, cut_sha binary, kept binary")
        if not with_text:
            cut = cut.drop("kept")
        cut = settle(cut, "cut")
        forget(hits, kinds, wanted, each, verdicts)
        self.compact()
        return marks.select("id", "tk", "n_words", "sha").join(cut.dropDuplicates(["id", "tk"]), ["id", "tk"], "left")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, batches: int = 2, with_text: bool = False, index: WindowIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and kept_text, words joined by one space).

    Removes each word covered by a window of ``width`` words whose sequence also starts in a document
    with a smaller id; windows are judged on the input. Null texts have no words, texts shorter
    than a window lose nothing, repeats inside one document don't count. Ids arrive in
    ``batches`` ranges, each judged against the runs before it; the result doesn't depend on
    their number. Rows that repeat an id are one document; each is judged by its own text against smaller
    ids. Rows without an id are left out. Other columns don't matter.

    index, history: an index that goes on growing, and the documents (with smaller ids) that it holds.
    """
    spark = docs.sparkSession
    own = index or WindowIndex(spark, width=width)
    lo, hi = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    at = F.col(id_col).cast("long")
    whole = docs.select(id_col, text_col)
    before = history.select(id_col, text_col) if history is not None else None
    out = None
    for k in range(batches if lo is not None else 0):
        a, z = lo + (hi + 1 - lo) * k // batches, lo + (hi + 1 - lo) * (k + 1) // batches
        if a == z:
            continue
        older = whole.filter(at < a) if before is None else before.union(whole.filter(at < a))
        rows = own.add(whole.filter((at >= a) & (at < z)), older if own.runs else None, id_col, text_col, with_text)
        out = rows if out is None else out.union(rows)
    if index is None:
        own.close(delete=True)
    if out is None:
        columns = "id long, tk long, n_words long, sha binary, n_removed long, cut_sha binary" + (", kept binary" if with_text else "")
        out = spark.createDataFrame([], columns)
    cols = [F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.lower(F.hex(F.coalesce("cut_sha", "sha"))).alias("kept_sha256")]
    if with_text:
        texts = _source(docs, id_col, text_col).dropDuplicates(["id", "tk"])
        out = out.join(texts, ["id", "tk"])
        plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        cols.append(F.coalesce(F.col("kept").cast("string"), plain).alias("kept_text"))
    return out.select(*cols)
