"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the hash covers the positions marked 1 and ignores
the others, so a test passage with substituted words still meets its source under some mask. Hits
join test and training hashes on equal values; around each hit the two texts are aligned
and the equal words counted. A document is contaminated when a stretch of ``window`` aligned words (the
whole item if shorter) agrees in at least ``agree`` of them.

The test side is collected only after its size is checked (``SMALL`` words); a larger one is joined
as a table, with a bit map of fixed size in front of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.shared import settle, small_batches, spread

#: Fixed masks. With 12 or 13 words and up to 2 substitutions at least one mask fits somewhere (tested).
MASKS = ("111011001", "10000110111", "1101010011", "111100101")
#: Items of 9 to 11 words have these, too: with them each length stands all substitutions that AGREE tolerates (tested).
MORE = ("10011111", "11101011", "10110111")
WINDOW, AGREE, LEAST = 13, 0.8, 5
SMALL = 1_000_000
_BITS = 24


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def masks_of(words: int) -> tuple[str, ...]:
    """The masks of an item of so many words; one under nine is matched as a whole."""
    if words < min(map(len, MASKS)):
        return ("1" * words,) if words >= LEAST else ()
    return MASKS + MORE if words < 12 else MASKS


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Seed hash at each start; the last span-1 words start none."""
    places = _places(mask)
    n = len(h) - places[-1]
    if n <= 0:
        return np.zeros(0, T.U)
    factor = T.powers(int(T._P), len(places) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, T.U)
        for k, p in enumerate(places):
            total += h[p : p + n] * factor[k + 1]
        return T.mix(total + T.U(int(mask, 2)))


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW) -> tuple[int, int]:
    """(most equal words within a window, the window's words) with item word q at document word q + shift."""
    w = min(window, len(item))
    a, z = max(0, -shift), min(len(item), len(doc) - shift)
    if z - a < w:
        return 0, w
    same = np.concatenate([[0], np.cumsum(doc[a + shift : z + shift] == item[a:z])])
    return int((same[w:] - same[:-w]).max()), w


class Tests:
    """Items as word hashes, their seeds sorted, and a bit map over all seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [], []
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.masks: tuple[str, ...] = ()
        for item, text in items:
            raw, off = T.string_bytes(pa.array([text or ""]))
            h = T.Words(T.lower(raw), off).hashes()
            if len(h) < LEAST:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(h)
            own = masks_of(len(h))
            self.masks = tuple(dict.fromkeys(self.masks + own))
            for m in own:
                s = seeds(h, m)
                if len(s):
                    rows.append((s, np.full(len(s), k), np.arange(len(s))))
        none = np.zeros(0, np.int64)
        value, owner, at = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (none.astype(T.U), none, none)
        order = np.argsort(value, kind="stable")
        self.value, self.owner, self.at = value[order], owner[order], at[order]
        self.map = bit_map(self.value)

    def hits(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(item, shift) of every seed that a document of these words shares."""
        found: set[tuple[int, int]] = set()
        for m in self.masks:
            s = seeds(h, m)
            at = np.flatnonzero(self.map[(s >> T.U(64 - _BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.value, s[at], "left"), np.searchsorted(self.value, s[at], "right")
            for p, a, z in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(zip(self.owner[a:z].tolist(), (p - self.at[a:z]).tolist(), strict=True))
        return found


def bit_map(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[(values >> T.U(64 - _BITS)).astype(np.int64)] = True
    return out


_RESULT = "id long, item_ids array<long>, max_overlap long"


def _search(tests, agree: float, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tests = tests.value
        for b in batches:
            ids = T.id_array(b.column(0))
            items, most = [], []
            for i, j, raw, off in T.parts(b.column(1)):
                words = T.Words(T.lower(raw), off)
                h = words.hashes()
                # which documents hold any seed at all, for the whole chunk at once
                suspect = np.zeros(j - i, bool)
                for m in t.masks:
                    at = np.flatnonzero(t.map[(seeds(h, m) >> T.U(64 - _BITS)).astype(np.int64)])
                    suspect[np.searchsorted(words.off, at, "right") - 1] = True
                for k in range(j - i):
                    own = h[words.off[k] : words.off[k + 1]]
                    best, found = 0, set()
                    if suspect[k] and len(own) >= LEAST:
                        for item, shift in t.hits(own):
                            same, w = overlap(own, t.words[item], shift, window)
                            best = max(best, same)
                            if same >= agree * w:
                                found.add(t.ids[item])
                    items.append(sorted(found))
                    most.append(best)
            yield pa.record_batch([pa.array(ids), pa.array(items, pa.list_(pa.int64())), pa.array(most, pa.int64())], names=["id", "item_ids", "max_overlap"])

    return run


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items' numbers of words up to 12, each once a batch."""
    for b in batches:
        found: set[int] = set()
        for _, _, raw, off in T.parts(b.column(1)):
            found.update(np.minimum(np.diff(T.Words(T.lower(raw), off).off), 12).tolist())
        yield pa.record_batch([pa.array(sorted(found), pa.int64())], names=["words"])


def _seed_rows(masks, bits=None):
    """(id, seed, at, and the third column if there is one) of a text column, by the masks that fit a number of words; with a bit map only the seeds that it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = T.id_array(b.column(0))
            for i, j, raw, off in T.parts(b.column(1)):
                words = T.Words(T.lower(raw), off)
                h = words.hashes()
                for k in range(j - i):
                    own = h[words.off[k] : words.off[k + 1]]
                    for m in masks(len(own)):
                        s = seeds(own, m)
                        at = np.arange(len(s)) if bits is None else np.flatnonzero(bits.value[(s >> T.U(64 - _BITS)).astype(np.int64)])
                        if len(at):
                            rest = [pa.array(np.full(len(at), b.column(2)[i + k].as_py(), np.int64))] if b.num_columns > 2 else []
                            yield pa.record_batch([pa.array(np.full(len(at), ids[i + k])), T.long_array(s[at]), pa.array(at), *rest], names=["id", "seed", "at", "h"][: 3 + len(rest)])

    return run


def _check_tries(agree: float, window: int):
    """Rows (id, h, text, tries array<struct<row, item, item_text, shifts>>) -> (id, h, item, ok, same): each text is hashed once a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = lambda text: T.Words(*(f(x) for f, x in zip((T.lower, lambda o: o), T.string_bytes(pa.array([text], pa.large_string())), strict=True))).hashes()
        for b in batches:
            known: dict[int, np.ndarray] = {}  # by row of the test table: rows may share an item id
            rows: list[tuple] = []
            for doc, h, text, tries in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), b.column("text"), b.column("tries"), strict=True):
                a = hashes(text.as_py())
                for t in tries.as_py():
                    if (c := known.get(t["row"])) is None:
                        c = known[t["row"]] = hashes(t["item_text"])
                    best = max((overlap(a, c, shift, window) for shift in t["shifts"]), default=(0, 1))
                    rows.append((doc, h, t["item"], len(c) >= LEAST and best[0] >= agree * best[1], best[0]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "h", "item", "ok", "same"])

    return run


def find_leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, agree: float = AGREE, small: int = SMALL) -> DataFrame:
    """One row per document: id, contaminated, item_ids (sorted), n_items, max_overlap (equal words in the best window).

    Words are runs without ASCII white space, A-Z lower-cased. Items under LEAST words identify
    nothing and are ignored; items shorter than every mask match as a whole. Null texts are empty and clean,
    an empty test table leaves every document clean, rows without an id are left out. Each row of ``docs`` is judged by its own text, also where
    rows share an id; of items that share an id each text counts, and their id is listed once. Other columns don't matter.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    items = tests.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("item_text")).filter("item is not null and item_text is not null")
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if size <= 6 * small:
        known = spark.sparkContext.broadcast(Tests([tuple(r) for r in items.collect()]))  # size checked above
        out = spread(source).mapInArrow(_search(known, agree, window), _RESULT)
    else:
        # bits of a fixed size, whatever the size of the test table
        items = settle(items.distinct().withColumn("row", F.monotonically_increasing_id()), "items")
        keys = settle(items.select("row", "item_text").mapInArrow(_seed_rows(masks_of), "id long, seed long, at long"), "keys")
        known = {r["words"] for r in items.select("row", "item_text").mapInArrow(_lengths, "words long").distinct().collect()}  # at most 13 numbers
        asked = tuple(dict.fromkeys(m for n in sorted(known) for m in masks_of(n)))
        slots = keys.select(F.shiftrightunsigned("seed", 64 - _BITS).alias("s")).groupBy(F.expr("int(s div 8)").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, int(s % 8))")).alias("bits"))
        packed = np.zeros(1 << (_BITS - 3), np.uint8)
        for byte, bits in slots.toLocalIterator():  # at most 2**21 rows
            packed[byte] = bits
        bits = spark.sparkContext.broadcast(np.unpackbits(packed, bitorder="little").astype(bool))
        source = source.withColumn("h", F.xxhash64("text"))  # rows of one id by their texts
        mine = settle(spread(source).mapInArrow(_seed_rows(lambda _: asked, bits), "id long, seed long, at long, h long"), "seeds")
        pairs = mine.join(keys.toDF("row", "seed", "q"), "seed").select("id", "h", "row", (F.col("at") - F.col("q")).alias("shift")).distinct()
        # an item's text goes to a document once, however many alignments are tried
        pairs = settle(pairs.groupBy("id", "h", "row").agg(F.collect_list("shift").alias("shifts")), "alignments")
        tries = pairs.join(items, "row").groupBy("id", "h").agg(F.collect_list(F.struct("row", "item", "item_text", "shifts")).alias("tries"))
        checked = source.join(tries, ["id", "h"]).mapInArrow(_check_tries(agree, window), "id long, h long, item long, ok boolean, same long")
        found = checked.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("item")))).alias("item_ids"), F.max("same").alias("max_overlap"))
        out = source.select("id", "h").join(found, ["id", "h"], "left").select("id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("max_overlap", F.lit(0)).alias("max_overlap"))
    return out.select(F.col("id").alias(id_col), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.size("item_ids").cast("long").alias("n_items"), "max_overlap")


def drop_leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no test passage, with all their columns; of rows that share an id all go if one does."""
    bad = find_leaks(docs, tests, id_col, text_col).filter("contaminated").select(F.col(id_col).alias("_bad_id"))
    return docs.join(bad, docs[id_col] == bad["_bad_id"], "left_anti")
