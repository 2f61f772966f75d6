"""Exact deduplication by Grace hashing.

Three steps, none of which sees an unbounded group:

1. Each Arrow batch is pre-aggregated in an open-addressing table, so a text that fills a third
   of the corpus leaves its batch as one representative row with a count.
2. Representatives are dealt by content hash; a hash with more than ``CELL`` of them is salted, so that a
   cell holds about that many. Within a task a hybrid Grace hash runs: a table of
   distinct contents within ``budget`` bytes; beyond it, entries go to spill files by the next
   hash bits and every file is solved on its own, recursively. Tables compare complete contents;
   a hash only chooses the slot.
3. The winners of salted cells, one of each content and cell, meet in a second round of the same kind.
4. Every row joins the answer of its representative (a key with at most one batch of rows).

Spill files lie in a folder of the task's own executor and end with the task; a task that is repeated
writes its own.
"""

from __future__ import annotations

import hashlib
import marshal
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.shared import settle, small_batches, spread

FANOUT_BITS = 4
#: Representatives of one hash that one cell takes, about.
CELL = 1000
_ANSWER = "rep long, keep_id long, winner long, group_size long"
_SCHEMA = "id long, uid long, rep long, sha binary, n long, text binary"


def squeeze(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; returns the bytes and the new offsets."""
    n = len(raw)
    space = T._SPACE[raw]
    follows = np.zeros(n, bool)
    if n:
        follows[1:] = space[:-1]
        follows[offsets[(offsets > 0) & (offsets < n)]] = False
    keep = ~(space & follows)
    counts = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=counts[1:])
    return np.where(space, np.uint8(0x20), raw)[keep].tobytes(), counts[offsets]


class OpenTable:
    """Open addressing with linear probing; ``find`` compares complete contents."""

    def __init__(self, size: int = 1024):
        self.slots = [-1] * size
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """(entry, whether it is new)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        e = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _h(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little") >> 1


def _preaggregate(raw_text: bool):
    """Columns id, text and others; the text (and the others) of a batch's copies go with one of them only.

    raw_text: that text as it came, not normalised.
    """
    return lambda batches: _preaggregated(batches, raw_text)


def _preaggregated(batches: Iterable[pa.RecordBatch], raw_text: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    uid = (context.partitionId() if context else 0) << 36
    for batch in batches:
        ids = T.id_array(batch.column(0)).tolist()
        for i, j, raw, off in T.parts(batch.column(1), 8 * T.CHUNK):
            text, cut = squeeze(raw, off)
            cut = cut.tolist()
            table, best, counts, entry, shas = OpenTable(), [], [], [], []
            for k in range(j - i):
                content = text[cut[k] : cut[k + 1]]
                sha = hashlib.sha256(content).digest()
                e, new = table.find(_h(sha), content)
                if new:
                    best.append(k)
                    counts.append(0)
                elif ids[i + k] < ids[i + best[e]]:
                    best[e] = k
                counts[e] += 1
                entry.append(e)
                shas.append(sha)
            rep = np.asarray(best, np.int64)[entry] if entry else np.zeros(0, np.int64)
            mine = rep == np.arange(j - i)
            once = [table.contents[e] if m else None for e, m in zip(entry, mine, strict=True)] if not raw_text else None
            texts = pa.array(once, pa.binary()) if once is not None else pc.if_else(pa.array(mine), batch.column(1).slice(i, j - i).cast(pa.binary()), pa.scalar(None, pa.binary()))
            others = [pc.if_else(pa.array(mine), c.slice(i, j - i), pa.scalar(None, c.type)) for c in batch.columns[2:]]
            yield pa.record_batch(
                [
                    pa.array(ids[i:j], pa.int64()),
                    pa.array(uid + np.arange(j - i)),
                    pa.array(uid + rep),
                    pa.array(shas, pa.binary()),
                    pa.array([counts[e] if m else None for e, m in zip(entry, mine, strict=True)], pa.int64()),
                    texts,
                    *others,
                ],
                names=["id", "uid", "rep", "sha", "n", "text", *batch.schema.names[2:]],
            )
            uid += j - i


def grace_groups(rows: Iterable[tuple], budget: int, folder: str, depth: int = 0) -> Iterator[tuple]:
    """rows: (hash, uid, id, count, content). Yields (members' uids, smallest id, its uid, count) of each content."""
    table = OpenTable()
    members: list[list[int]] = []
    best: list[tuple[int, int]] = []
    counts: list[int] = []
    rows = iter(rows)
    for h, uids, at, n, content in rows:
        e, new = table.find(h, content)
        if new:
            members.append(list(uids))
            best.append(at)
            counts.append(n)
        else:
            members[e] += uids
            best[e] = min(best[e], at)
            counts[e] += n
        if table.bytes > budget and len(counts) > 1 and depth < 60 // FANOUT_BITS:
            break
    else:
        yield from zip(members, best, counts, strict=True)
        return

    fan, shift = 1 << FANOUT_BITS, FANOUT_BITS * depth

    def pending() -> Iterator[tuple]:
        for e, content in enumerate(table.contents):
            yield table.hashes[e], members[e], best[e], counts[e], content
        yield from rows

    names = [os.path.join(folder, f"{depth}-{i}-{os.urandom(4).hex()}") for i in range(fan)]
    files = [open(name, "wb") for name in names]  # noqa: SIM115
    try:
        for row in pending():
            marshal.dump(row, files[(row[0] >> (58 - shift if shift <= 56 else 0)) & (fan - 1)])
    finally:
        for f in files:
            f.close()
    table, members, best, counts = OpenTable(), [], [], []
    for name in names:
        yield from grace_groups(_spilled(name), budget, folder, depth + 1)
        os.unlink(name)


def _spilled(name: str) -> Iterator[tuple]:
    with open(name, "rb") as f:
        while True:
            try:
                yield marshal.load(f)
            except EOFError:
                return


def _resolve(budget: int):
    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                ids, uids, shas, counts, texts = (b.column(c) for c in ("id", "uid", "sha", "n", "text"))
                for k in range(b.num_rows):
                    at = (ids[k].as_py(), uids[k].as_py())
                    yield _h(shas[k].as_py()), [at[1]], at, counts[k].as_py(), texts[k].as_py()

        with tempfile.TemporaryDirectory() as folder:
            out: list[tuple] = []
            for members, (keep, winner), n in grace_groups(rows(), budget, folder):
                out += [(m, keep, winner, n) for m in members]
                if len(out) >= 20_000:
                    yield _answers(out)
                    out = []
            yield _answers(out)

    return solve


def _answers(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["rep", "keep_id", "winner", "group_size"])


def _answered(reps: DataFrame, normal: Callable[[DataFrame], DataFrame], budget: int) -> DataFrame:
    """Settled representatives (id, uid, sha, n, text) -> (rep, keep_id, winner, group_size); normal: makes their texts comparable, text last."""
    hot = settle(reps.groupBy("sha").agg(F.count("*").alias("reps")).filter(F.col("reps") > CELL).select("sha", F.ceil(F.col("reps") / CELL).cast("long").alias("salts")), "hot")
    if hot.isEmpty():
        return normal(reps).repartition("sha").mapInArrow(_resolve(budget), _ANSWER)
    salted = reps.join(hot, "sha", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("uid"), "salts"), F.lit(0))).select("id", "uid", "sha", "n", "salt", "text")
    cells = settle(normal(salted).repartition("sha", "salt").mapInArrow(_resolve(budget), _ANSWER), "cells")
    firsts = reps.join(hot, "sha", "left_semi").select("uid", "sha", "text")
    firsts = firsts.join(cells.select(F.col("winner").alias("uid"), F.col("keep_id").alias("id"), F.col("group_size").alias("n")).distinct(), "uid").select("id", "uid", "sha", "n", "text")
    second = normal(firsts).repartition("sha").mapInArrow(_resolve(budget), _ANSWER)
    second = settle(second.toDF("winner", "all_keep", "all_winner", "all_size"), "second")
    return cells.join(second, "winner", "left").select("rep", F.coalesce("all_keep", "keep_id").alias("keep_id"), F.coalesce("all_winner", "winner").alias("winner"), F.coalesce("all_size", "group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null
    counts as empty, empty texts equal each other. The smallest id stays; of rows that repeat an
    id and text, one stays. Rows without an id are left out. Other columns don't matter and an
    empty table gives an empty result. ``budget``: bytes of distinct contents in one table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    local = settle(spread(rows).mapInArrow(_preaggregate(False), _SCHEMA), "exact")
    groups = _answered(local.filter("n is not null").select("id", "uid", "sha", "n", "text"), lambda rows: rows, budget)
    return (
        local.select("id", "uid", "rep", "sha")
        .join(groups, "rep")
        .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("winner")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def _squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, raw, off in T.parts(b.column("text")):
            text, cut = squeeze(raw, off)
            part = b.slice(i, j - i)
            yield pa.record_batch([*part.columns[:-1], pa.array([text[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=part.schema.names)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the smallest id, of repeated rows one."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), rest).filter("id is not null")
    kind = rows.schema["rest"].dataType.simpleString()
    local = settle(spread(rows).mapInArrow(_preaggregate(True), f"{_SCHEMA}, rest {kind}").filter("n is not null").drop("rep"), "exact")
    squeezed = lambda rows: rows.mapInArrow(_squeezed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    winners = _answered(local.select("id", "uid", "sha", "n", "text"), squeezed, budget).select("winner").distinct()
    kept = local.join(winners, local["uid"] == winners["winner"], "left_semi")
    text = F.col("text").cast("string").cast(docs.schema[text_col].dataType)
    return kept.select(*[text.alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns])
