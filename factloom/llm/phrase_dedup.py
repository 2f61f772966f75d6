"""Repeated byte strings by prefix-free parsing and suffix arrays.

Texts are cut by a rolling hash: a position is a trigger when the hash of the ``GRAM`` bytes there is
the least of some window of the wanted length, so every repeated string contains a trigger at the
same place in each of its copies. Between triggers lie phrases; the text from a phrase's first
byte on, extended by what follows until its last window is complete, is a dictionary entry, and
a document's parse is its sequence of entries.

1. Triggers are counted; those seen once in the whole corpus can't be in a repeated string.
2. The dictionary counts distinct entries at the remaining triggers. A text that is repeated a
   thousand times is one entry: all windows of an entry with two occurrences are repeated.
3. Only entries that occur once need comparing. For all entries of a trigger a suffix array is
   built (prefix doubling up to the window length); windows adjacent in it with a common prefix
   of the full length are repeated.
4. The parse carries the verdicts back to the documents.

Corpus order: two suffixes are ordered by their entries as long as these differ, by the parse behind them
where the entries are equal. A window never leaves the entry that it starts in, as an entry is
extended until its last window is complete, so the first ``length`` bytes of every suffix are ordered
by the dictionary alone, and suffixes with different triggers share no window. What the parse
has to add is which document each entry stands in: that is step 4. (Held against all windows of all texts in the tests.)

A trigger with very many distinct entries (a passage with other surroundings each time) has its
phrases cut: all windows that hold the trigger at about the same place form a shorter entry, is
counted again, and is compared within the cell of entries that agree in the bytes common to all of
its windows, by a suffix array again. Cells that are still too large are cut again, down to single windows,
which counting settles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.llm.window_index import _lists
from factloom.shared import forget, settle, small_batches, spread

LENGTH = 200
GRAM = 50
#: Distinct entries that one suffix array compares; beyond it they are cut.
HOT = 2000
#: Places of the trigger in one cut entry, level by level.
CUTS = (32, 8, 1)
#: Bytes of entries in one suffix array.
SLAB = 1 << 19


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best(values[i:i+width]) for each i, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[: len(values) - step], values[step:])
        have += step
    return values


class Parse:
    """Triggers and phrases of a chunk of texts."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        width = length - gram + 1
        self.triggers, self.trigger_at = np.zeros(0, T.U), np.zeros(0, np.int64)
        self.first = self.count = np.zeros(0, np.int64)
        self.h = np.zeros(0, T.U)
        if len(raw) < length:
            return
        values = np.maximum(T.byte_grams(raw, gram), T.U(1))
        least = _slide(values, width, np.minimum)
        least = np.where(T.within(off, length, len(raw)), least, T.U(0))
        # a gram triggers if it is the least of some window over it
        padded = np.concatenate([np.zeros(width - 1, T.U), least, np.zeros(width - 1, T.U)])
        self.trigger_at = np.flatnonzero(_slide(padded, width, np.maximum) == values)
        self.triggers = values[self.trigger_at]
        valid = least > 0
        turn = np.ones(len(least), bool)
        turn[1:] = least[1:] != least[:-1]
        starts = off[(off > 0) & (off < len(least))]
        turn[starts] = True
        first = np.flatnonzero(turn)
        count = np.diff(np.append(first, len(least)))
        ok = valid[first]
        self.first, self.count, self.h = first[ok], count[ok], least[first[ok]]


def _mark(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in T.parts(b.column("text")):
                p = Parse(raw, off, length)
                cut = np.searchsorted(p.trigger_at, off)
                data = raw.tobytes()
                once, twice, shas = [], [], []
                for k in range(j - i):
                    u, n = np.unique(p.triggers[cut[k] : cut[k + 1]], return_counts=True)
                    once.append(u)
                    twice.append(u[n > 1])
                    shas.append(hashlib.sha256(data[off[k] : off[k + 1]]).digest())
                part = b.slice(i, j - i)
                yield pa.record_batch([part.column("id"), part.column("tk"), pa.array(np.diff(off)), pa.array(shas, pa.binary()), _lists(once), _lists(twice)], names=["id", "tk", "n_bytes", "sha", "prints", "twice"])

    return run


def _entries(length: int):
    """Rows (id, tk, text, shared triggers) -> (id, tk, first, count, h, ck) of each dictionary entry at a shared trigger."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tks, hits = T.id_array(b.column("id")), T.id_array(b.column("tk")), b.column("hits")
            for i, j, raw, off in T.parts(b.column("text")):
                p = Parse(raw, off, length)
                cut = np.searchsorted(p.first, off)
                ok = np.zeros(len(p.first), bool)
                for k in range(j - i):
                    ok[cut[k] : cut[k + 1]] = np.isin(p.h[cut[k] : cut[k + 1]], hits[i + k].values.to_numpy(zero_copy_only=False).view(T.U))
                own = T.owners(cut)[ok] if len(ok) else np.zeros(0, np.int64)
                first, count, h = p.first[ok], p.count[ok], p.h[ok]
                ck = _span_hash(raw, first, first + count + length - 1)
                yield pa.record_batch([pa.array(ids[i:j][own]), pa.array(tks[i:j][own]), pa.array(first - off[own]), pa.array(count), T.long_array(h), T.long_array(ck)], names=["id", "tk", "first", "count", "h", "ck"])

    return run


def _span_hash(raw: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hash of the bytes raw[a:z], for each pair, with their number."""
    n = len(raw)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, T.U)
        np.cumsum(T._BYTE[1][raw] * T.powers(int(T._Q), n)[:n], out=sums[1:])
        return T.mix((sums[z] - sums[a]) * T.powers(T.inverse(int(T._Q)), n)[a] ^ (z - a).astype(T.U))


def _fetch(length: int):
    """Rows (id, text, wanted entries) -> the entries' bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column("want")
            for i, j, raw, off in T.parts(b.column("text")):
                data = raw.tobytes()
                rows: list[tuple] = []
                for k in range(j - i):
                    for w in want[i + k].as_py():
                        a = off[k] + w["first"]
                        rows.append((w["h"], w["ck"], w["n"], w["hot"], data[a : a + w["count"] + length - 1]))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h", "ck", "n", "hot", "entry"])

    return run


_CUT = "h long, ck long, base long, once boolean, n long, at array<long>, count long, core long, content long, entry binary"


def _cut(length: int, places: int, gram: int = GRAM):
    """Rows (h, ck, base, n, entry) -> the entry's shorter entries, each once, with all their first windows ``at``.

    The windows of one hold the trigger at ``places`` neighbouring places at most, always divided
    alike, so equal windows of two entries come into shorter entries with the same ``core``: the
    bytes that all windows with the trigger at these places have in common. ``n`` counts an entry's repeats inside its own text.
    """
    width = length - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ck, base, n = (b.column(c).to_pylist() for c in ("h", "ck", "base", "n"))
            for i, j, raw, off in T.parts(b.column("entry")):
                data = raw.tobytes()
                start = np.flatnonzero(T.within(off, length, len(raw))) if len(raw) >= length else np.zeros(0, np.int64)
                if not len(start):
                    continue
                trigger = T.sliding_argmin(np.maximum(T.byte_grams(raw, gram), T.U(1)), width)[start]
                block = (trigger - start) // places
                turn = np.ones(len(start), bool)
                turn[1:] = (start[1:] != start[:-1] + 1) | (trigger[1:] != trigger[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(turn)
                count = np.diff(np.append(first, len(start)))
                a, t, low = start[first], trigger[first], block[first] * places
                high = np.minimum(low + places, width) - 1
                content = _span_hash(raw, a, a + count + length - 1).view(np.int64).tolist()
                core = _span_hash(raw, t - low, t - high + length).view(np.int64).tolist()
                own = np.searchsorted(off, a, "right") - 1
                rows: dict[tuple, list] = {}
                for k, o, x, c in zip(range(len(a)), own.tolist(), a.tolist(), count.tolist(), strict=True):
                    at = x - int(off[o])
                    if (row := rows.get((o, core[k], content[k]))) is None:
                        e = i + o
                        rows[o, core[k], content[k]] = [h[e], ck[e], base[e], n[e] == 1, n[e], [at], c, core[k], content[k], data[x : x + c + length - 1]]
                    else:
                        row[4] += n[i + o]
                        row[5].append(at)
                kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64()] + [pa.list_(pa.int64())] + [pa.int64()] * 3 + [pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows.values(), strict=True), kinds, strict=True)], names=["h", "ck", "base", "once", "n", "at", "count", "core", "content", "entry"])

    return run


def _cut_hot(entries: DataFrame, length: int, hot: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Entries (h, ck, n, entry) of hot triggers -> verdicts (h, ck, at), cells to compare, and settled tables.

    Each level counts the shorter entries: those seen again are settled, those alone in their cell
    repeat nothing, the rest are compared or cut again.
    """
    verdicts, cells, made = [], [], []
    rows = entries.select("h", "ck", F.lit(0).cast("long").alias("base"), "n", "entry")
    for places in CUTS:
        parts = settle(rows.mapInArrow(_cut(length, places), _CUT), "cuts")
        kinds = parts.groupBy("h", "core", "content").agg(F.sum("n").alias("n"), F.min(F.struct("ck", "base", "at")).alias("of"), F.any_value("entry").alias("entry"))
        kinds = settle(kinds, "kinds")
        made += [parts, kinds]
        again = parts.filter("once").join(kinds.filter("n > 1").select("h", "core", "content"), ["h", "core", "content"], "left_semi")
        verdicts.append(again.select("h", "ck", F.expr("flatten(transform(at, x -> sequence(base + x, base + x + count - 1)))").alias("at")))
        mixed = kinds.groupBy("h", "core").agg(F.count("*").alias("size"), F.min("n").alias("rarest")).filter("size > 1 and rarest = 1")
        left = kinds.join(mixed.select("h", "core", (F.col("size") > hot).alias("hot")), ["h", "core"])
        left = settle(left.select("h", "core", F.col("of.ck").alias("ck"), (F.col("of.base") + F.col("of.at")[0]).alias("base"), "n", "hot", "entry"), "cells")
        made.append(left)
        cells.append(left.filter("not hot").select("h", "core", "ck", "base", "n", "entry"))
        rows = left.filter("hot").select("h", "ck", "base", "n", "entry")
        if rows.isEmpty():
            break
    return verdicts, cells, made


def suffix_ranks(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, rank) of every window of ``length`` bytes inside one entry.

    Prefix doubling: ranks by the first 8, 16, 32 ... bytes, each from the ranks of two halves;
    the last step joins two overlapping halves into the full length. Equal ranks: equal windows.
    """
    n = len(raw)
    start = np.flatnonzero(T.within(off, length, n)) if n >= length else np.zeros(0, np.int64)
    if not len(start):
        return start, start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(T.U)
    key = np.zeros(n, T.U)
    for k in range(8):
        key = (key << T.U(8)) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1]
    have = 8
    while 2 * have <= length:
        second = np.concatenate([rank[have:], np.zeros(min(have, n), np.int64)])[:n]
        rank = np.unique(rank * np.int64(n + 1) + second, return_inverse=True)[1]
        have *= 2
    if have < length:
        both = rank[start] * np.int64(n + 1) + rank[start + length - have]
    else:
        both = rank[start]
    return start, np.unique(both, return_inverse=True)[1]


def _compare(length: int):
    """Entries (h, core, ck, base, n, entry) sorted by cell -> (h, ck, at): the windows of once-seen entries that another window equals."""

    def solve(rows: list[tuple]) -> list[tuple]:
        entries = [r[5] for r in rows]
        off = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(e) for e in entries], out=off[1:])
        start, rank = suffix_ranks(np.frombuffer(b"".join(entries), np.uint8), off, length)
        if not len(start):
            return []
        own = np.searchsorted(off, start, "right") - 1
        times = np.array([r[4] for r in rows], np.int64)
        total = np.bincount(rank, weights=times[own])
        again = (total[rank] > 1) & (times[own] == 1)
        found: dict[int, list[int]] = {}
        for o, at in zip(own[again].tolist(), (start - off[own])[again].tolist(), strict=True):
            found.setdefault(o, []).append(rows[o][3] + at)
        return [(rows[o][0], rows[o][2], at) for o, at in found.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 3
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["h", "ck", "at"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "core", "ck", "base", "n", "entry")), strict=True):
                if size > SLAB and rows[-1][:2] != row[:2]:
                    yield out(solve(rows))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield out(solve(rows))

    return run


def _finish(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            found = b.column("removed")
            for i, j, raw, off in T.parts(b.column("text")):
                for k in range(j - i):
                    text = raw[off[k] : off[k + 1]]
                    edge = np.zeros(len(text) + 1, np.int64)
                    for r in found[i + k].as_py():
                        if r["at"] is None:
                            edge[r["first"]] += 1
                            edge[r["first"] + r["count"] + length - 1] -= 1
                        else:
                            at = r["first"] + np.asarray(r["at"], np.int64)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    kept = text[~gone].tobytes()
                    rows.append((b.column("id")[i + k].as_py(), b.column("tk")[i + k].as_py(), int(gone.sum()), spans, hashlib.sha256(kept).digest(), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "tk", "n_removed", "n_spans", "sha", "kept"])

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes).

    Removes each UTF-8 byte covered by a string of ``length`` bytes (over GRAM) that also starts anywhere
    else, in this document or another; overlaps count, strings are judged on the input and never
    cross documents. Null counts as empty; texts under ``length`` bytes lose nothing. A row that repeats an
    id is a document of its own (its text counts as a copy); rows without an id are left out. Other
    columns don't matter.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    source = source.withColumn("tk", F.xxhash64("text"))  # tells rows that repeat an id with another text apart
    marks = settle(spread(source).mapInArrow(_mark(length), "id long, tk long, n_bytes long, sha binary, prints array<long>, twice array<long>"), "triggers")
    prints = marks.select("id", "tk", F.explode("prints").alias("h"))
    shared = prints.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h").union(marks.select(F.explode("twice").alias("h"))).distinct()
    shared = settle(shared, "shared")
    per_doc = prints.join(shared, "h", "left_semi").groupBy("id", "tk").agg(F.collect_set("h").alias("hits"))
    marked = settle(source.join(per_doc, ["id", "tk"]), "marked")
    parse = settle(marked.mapInArrow(_entries(length), "id long, tk long, first long, count long, h long, ck long"), "parse")

    dictionary = settle(parse.groupBy("h", "ck").agg(F.count("*").alias("n"), F.min(F.struct("id", "tk", "first", "count")).alias("at")), "dictionary")
    sizes = settle(dictionary.groupBy("h").agg(F.count("*").alias("size"), F.min("n").alias("rarest")).filter("rarest = 1").select("h", (F.col("size") > hot).alias("hot")), "sizes")
    wanted = dictionary.join(sizes, "h").select("at.id", "at.tk", "h", "ck", "n", "at.first", "at.count", "hot")
    wanted = wanted.groupBy("id", "tk").agg(F.collect_list(F.struct("h", "ck", "n", "first", "count", "hot")).alias("want"))
    fetched = settle(marked.join(wanted, ["id", "tk"]).mapInArrow(_fetch(length), "h long, ck long, n long, hot boolean, entry binary"), "entries")
    none = F.lit(0).cast("long")
    cells = fetched.filter("not hot").select("h", none.alias("core"), "ck", none.alias("base"), "n", "entry")
    counted, cut_cells, made = ([], [], []) if fetched.filter("hot").isEmpty() else _cut_hot(fetched.filter("hot"), length, hot)
    for part in cut_cells:
        cells = cells.union(part)
    some = cells.repartition("h", "core").sortWithinPartitions("h", "core", "ck", "base").mapInArrow(_compare(length), "h long, ck long, at array<long>")
    for part in counted:
        some = some.union(part)
    some = settle(some, "verdicts")
    verdicts = dictionary.select("h", "ck", "n").join(some, ["h", "ck"], "left").filter("n > 1 or at is not null").select("h", "ck", F.expr("if(n > 1, null, at)").alias("at"))
    verdicts = settle(verdicts, "verdicts")  # so that the join below is one that AQE can split where an entry is hot
    removed = parse.join(verdicts, ["h", "ck"]).groupBy("id", "tk").agg(F.collect_list(F.struct("first", "count", "at")).alias("removed"))
    cut = marked.join(removed, ["id", "tk"]).mapInArrow(_finish(length), "id long, tk long, n_removed long, n_spans long, cut_sha binary, kept binary")
    if not with_bytes:
        cut = cut.drop("kept")
    cut = settle(cut, "cut")
    forget(marked, parse, dictionary, fetched, some, verdicts, *made)
    out = marks.select("id", "tk", "n_bytes", "sha").join(cut.dropDuplicates(["id", "tk"]), ["id", "tk"], "left")
    cols = [F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.lower(F.hex(F.coalesce("cut_sha", "sha"))).alias("kept_sha256")]
    if with_bytes:
        out = out.join(source.dropDuplicates(["id", "tk"]), ["id", "tk"])
        cols.append(F.coalesce("kept", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kept_bytes"))
    return out.select(*cols)
