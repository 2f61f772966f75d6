"""Near-duplicate components by MinHash with sequential Bayesian verification.

1. Documents become sets of word shingles; equal sets collapse to their smallest id.
2. MinHash signatures, banded; buckets of one document fall away.
3. A bucket's hub is its smallest id. Each document is compared with one hub, the one that it
   shares most buckets with (a star, never all pairs). Signatures are compared in batches: a
   pair is pruned as soon as the posterior probability that its similarity reaches the
   threshold falls below ``miss``. Survivors are verified on full sets.
4. Components of the verified links. Only buckets that still hold several components can hide a
   link the stars did not try; there, members of different components are compared. A bucket's
   largest component is dealt in blocks against the rest, the rest among itself in pairs of
   blocks. Cells first see signatures only (400 bytes a member) and return the members with a partner
   that pruning leaves and that share no earlier band; only these fetch their texts. A cell then verifies pairs
   on full sets and skips what is connected by then, so it returns fewer links than it
   has members, however many pairs it looks at.
5. Final components over all verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.llm.components import components
from factloom.shared import forget, settle, small_batches, spread

BANDS, ROWS, BATCH = 40, 5, 25
MISS = 1e-6
BLOCK = 512
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_X = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets by text). Fewer than k words: the whole sequence is one."""
    words = T.Words(T.lower(raw), off)
    h = words.hashes()
    counts = np.diff(words.off)
    starts = np.flatnonzero(T.within(words.off, k, len(h))) if len(h) >= k else np.zeros(0, np.int64)
    own = np.searchsorted(words.off, starts, "right") - 1
    values = T.grams(h, k)[starts] if len(starts) else np.zeros(0, T.U)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        few = np.array([T.grams(h[words.off[i] : words.off[i + 1]], int(counts[i]))[0] ^ T.U(int(counts[i])) for i in short], T.U)
        own, values = np.concatenate([own, short]), np.concatenate([values, T.mix(few)])
        order = np.argsort(own, kind="stable")
        own, values = own[order], values[order]
    bounds = np.searchsorted(own, np.arange(len(off)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    if len(values):
        fresh[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    seen = np.zeros(len(values) + 1, np.int64)
    np.cumsum(fresh, out=seen[1:])
    return values[fresh], seen[bounds]


def sets_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a whole column, a chunk at a time: the hashes of a chunk are many times its text."""
    values, sizes = [np.zeros(0, T.U)], [np.zeros(1, np.int64)]
    for _, _, raw, off in T.parts(texts, T.CHUNK // 2):
        v, bounds = shingle_sets(raw, off, k)
        values.append(v)
        sizes.append(np.diff(bounds))
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each of BANDS * ROWS minima, for each non-empty set: (sets, functions)."""
    full = np.flatnonzero(np.diff(bounds))
    x = (values >> T.U(32)).astype(np.uint32)
    out = np.empty((len(_A), len(full)), np.uint16)
    starts = bounds[full]
    v = np.empty_like(x)
    for k in range(len(_A)):
        np.bitwise_xor(x, _X[k], out=v)
        np.multiply(v, _A[k], out=v)
        low = np.minimum.reduceat(v, starts)
        low ^= low >> np.uint32(15)
        low *= np.uint32(0x2C1B3C6D)
        out[k] = low >> np.uint32(16)
    return np.ascontiguousarray(out.T)


def _sign(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = T.id_array(b.column(0))
            for i, j, raw, off in T.parts(b.column(1)):
                values, bounds = shingle_sets(raw, off, shingle)
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    sums = np.zeros((2, len(values) + 1), T.U)
                    np.cumsum(values, out=sums[0, 1:])
                    np.cumsum(T.mix(values ^ T.U(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
                    prints = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                sig: list[bytes | None] = [None] * (j - i)
                if len(values):
                    for at, s in zip(np.flatnonzero(n), signatures(values, bounds), strict=True):
                        sig[at] = s.tobytes()
                yield pa.record_batch([pa.array(ids[i:j]), pa.array(n), T.long_array(prints[0]), T.long_array(prints[1]), pa.array(sig, pa.binary())], names=["id", "n", "f1", "f2", "sig"])

    return run


@cache
def prune_table(threshold: float, miss: float, functions: int = BANDS * ROWS, batch: int = BATCH) -> tuple[int, ...]:
    """After each batch: the fewest agreements at which P(similarity >= threshold | agreements) >= miss.

    With a uniform prior the posterior is a beta distribution; its tail is a binomial sum.
    """
    out = []
    for n in range(batch, functions + 1, batch):
        logs = [math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k) + k * math.log(threshold) + (n + 1 - k) * math.log1p(-threshold) for k in range(n + 1)]
        tail, least = 0.0, n
        for m in range(n + 1):
            tail += math.exp(logs[m])
            if tail >= miss:
                least = m
                break
        out.append(least)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Rows of two signature matrices (the same shape) that no batch prunes."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), np.int32)
    for step, least in enumerate(prune_table(threshold, miss)):
        cols = slice(step * BATCH, (step + 1) * BATCH)
        agree = agree + (a[alive, cols] == b[alive, cols]).sum(1)
        ok = agree >= least
        alive, agree = alive[ok], agree[ok]
        if not len(alive):
            break
    return alive


def _matrix(col: pa.Array) -> np.ndarray:
    raw, _ = T.string_bytes(col)
    return raw.view(np.uint16).reshape(len(col), BANDS * ROWS) if len(col) else np.zeros((0, BANDS * ROWS), np.uint16)


def _prune_pairs(threshold: float, miss: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = survivors(_matrix(b.column("sa")), _matrix(b.column("sb")), threshold, miss)
            yield pa.record_batch([b.column("a").take(pa.array(ok)), b.column("b").take(pa.array(ok))], names=["a", "b"])

    return run


class _Cell:
    """Rows (key, kind, bi, bj, band, id, comp, n, side, sig) of one cell; pairs are of side 0 with side 1, or within side 0 where a cell has one block."""

    def __init__(self, rows: list):
        self.across_only, self.band = rows[0][1] or rows[0][2] != rows[0][3], rows[0][4]
        self.n = np.array([r[7] for r in rows], np.int64)
        self.side = np.array([r[8] for r in rows])
        self.sig = np.frombuffer(b"".join(r[9] for r in rows), np.uint16).reshape(len(rows), -1)
        self.by_band = self.sig.reshape(len(rows), BANDS, ROWS)
        names = {c: i for i, c in enumerate(dict.fromkeys(r[6] for r in rows))}
        self.root = np.array([names[r[6]] for r in rows])  # relabelled as components merge

    def pairs(self, threshold: float, miss: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of side 0 with its partners in other components that no batch prunes and that share no earlier band."""
        n, sig, root, other = self.n, self.sig, self.root, np.flatnonzero(self.side == 1)
        for i in np.flatnonzero(self.side == 0).tolist():
            js = other if self.across_only else np.arange(i + 1, len(n))
            js = js[(root[js] != root[i]) & (np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i]) - 1e-9)]
            if len(js):
                js = js[survivors(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], threshold, miss)]
            if len(js):
                js = js[(self.by_band[js] == self.by_band[i]).all(2).argmax(1) == self.band]
            if len(js):
                yield i, js


def _by_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """Rows sorted by cell (the first four columns) -> the rows of each."""
    rows: list = []
    for b in batches:
        for at in range(0, b.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                if rows and rows[0][:4] != row[:4]:
                    yield rows
                    rows = []
                rows.append(row)
    if rows:
        yield rows


_CELL = "key long, kind boolean, bi int, bj int, band int, id long, comp long, n long, side int, sig binary"


def _likely_members(threshold: float, miss: float):
    """Rows sorted by cell -> those with a partner to be verified."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for rows in _by_cell(batches):
            keep = np.zeros(len(rows), bool)
            for i, js in _Cell(rows).pairs(threshold, miss):
                keep[i] = True
                keep[js] = True
            if keep.any():
                cols = zip(*(r for r, k in zip(rows, keep.tolist(), strict=True) if k), strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _CELL.split(", ")])

    return run


def _link_cells(threshold: float, miss: float, percent: int, shingle: int):
    """Rows (those of a cell, text) sorted by cell -> verified links between different components."""

    def solve(rows: list) -> list[tuple[int, int]]:
        cell = _Cell(rows)
        root = cell.root
        values, bounds = sets_of(pa.array([r[10] for r in rows], pa.large_string()), shingle)
        found = []
        for i, js in cell.pairs(threshold, miss):
            size = bounds[js + 1] - bounds[js]
            own = values[bounds[i] : bounds[i + 1]]
            at = np.repeat(bounds[js] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            place = np.minimum(np.searchsorted(own, values[at]), len(own) - 1)
            both = np.add.reduceat((own[place] == values[at]).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
            for j in js[100 * both >= percent * (size + len(own) - both)].tolist():
                if root[j] != root[i]:
                    found.append((rows[i][5], rows[j][5]))
                    root[root == root[j]] = root[i]
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [(), ()]
            done.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for rows in _by_cell(batches):
            done.update(solve(rows))
            if len(done) > 20_000:
                yield out()
        yield out()

    return run


def _deal(members: DataFrame) -> DataFrame:
    """members (key, band, id, n, comp) -> the cells of buckets with several components, each a bounded number of rows."""
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("nm"), (F.col("size") - F.col("top.c")).alias("rest"))
    rows = members.join(mixed, "key").withColumns({"is_main": F.col("comp") == F.col("main"), "nr": F.ceil(F.col("rest") / BLOCK).cast("int")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("nm")).otherwise(F.col("nr"))).cast("int"))
    to = lambda count, f: F.transform(F.sequence(F.lit(0), count - 1), f)
    cell = lambda kind, bi, bj, side: F.struct(F.lit(kind).alias("kind"), bi.alias("bi"), bj.alias("bj"), side.alias("side"))
    own = F.col("own")
    main = to(F.col("nr"), lambda j: cell(True, own, j, F.lit(0)))
    rest = to(F.col("nm"), lambda i: cell(True, i, own, F.lit(1)))
    among = to(F.col("nr"), lambda o: cell(False, F.least(own, o), F.greatest(own, o), F.when(own <= o, 0).otherwise(1)))
    rest = F.when(F.col("rest") > 1, F.concat(rest, among)).otherwise(rest)
    rows = rows.withColumn("cell", F.explode(F.when(F.col("is_main"), main).otherwise(rest)))
    return rows.select("key", "cell.kind", "cell.bi", "cell.bj", "band", "id", "comp", "n", "cell.side")


def _verify(percent: int, shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                va, ba = sets_of(part.column("ta"), shingle)
                vb, bb = sets_of(part.column("tb"), shingle)
                for k in range(part.num_rows):
                    x, y = va[ba[k] : ba[k + 1]], vb[bb[k] : bb[k + 1]]
                    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[at + k] = 100 * both >= percent * (len(x) + len(y) - both)
            ok = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([b.column("a").take(ok), b.column("b").take(ok)], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5, miss: float = MISS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Links texts with 100 * |intersection| >= percent * |union| of their distinct word shingles (A-Z
    lower-cased). Null, empty and blank texts have no shingles and no links. component_id is the
    smallest id reachable; kept marks it. Rows that repeat an id count as one document and get
    equal rows; rows without an id are left out; other columns don't matter. Banding misses a pair
    at the threshold itself with probability (1 - t**ROWS)**BANDS, about 2e-5; ``miss`` bounds what
    each pruning step loses.
    """
    small_batches(docs.sparkSession)
    t = percent / 100
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    signed = settle(spread(source).mapInArrow(_sign(shingle), "id long, n long, f1 long, f2 long, sig binary"), "signed")
    classes = signed.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    reps = settle(signed.join(classes.select("rep"), signed["id"] == F.col("rep"), "left_semi").select("id", "n", "sig").dropDuplicates(["id"]), "reps")

    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.substring("sig", width * j + 1, width), F.lit(j)) for j in range(BANDS)])
    rows = reps.select("id", "n", F.posexplode(keys).alias("band", "key"))
    hubs = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top").select("key", "hub")
    shared = settle(rows.join(hubs, "key").select("key", "band", "id", "n", "hub"), "buckets")

    sigs = reps.select("id", "sig")
    votes = shared.filter("id != hub").groupBy("id", "hub").agg(F.count("*").alias("votes"))
    stars = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("hub")).alias("low"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.low")).alias("b"))
    stars = stars.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    likely = settle(stars.mapInArrow(_prune_pairs(t, miss), "a long, b long"), "stars")
    texts = settle(source.join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")

    both = likely.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    links = settle(both.mapInArrow(_verify(percent, shingle), "a long, b long"), "links")
    first = settle(components(links), "components")
    members = shared.select("key", "band", "id", "n").join(first.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    members = settle(members.select("key", "band", "id", "n", "comp"), "members")
    by_cell = lambda rows: rows.repartition("key", "kind", "bi", "bj").sortWithinPartitions("key", "kind", "bi", "bj", "id")
    dealt = _deal(members).join(sigs, "id").select(*(c.split()[0] for c in _CELL.split(", ")))
    dealt = settle(by_cell(dealt).mapInArrow(_likely_members(t, miss), _CELL), "likely")
    dealt = by_cell(dealt.join(texts, "id").select(*dealt.columns, "text"))
    more = settle(dealt.mapInArrow(_link_cells(t, miss, percent, shingle), "a long, b long").distinct(), "links")
    final = settle(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")
    forget(texts, shared, members)

    # one row a set, settled, so that the join of all documents is one that AQE can split where a set is hot
    named = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "f1", "f2").join(settle(named, "named"), ["f1", "f2", "n"], "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), (comp == F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One document of each component stays (the smallest id), with all its columns."""
    kept = near_dedup(docs, id_col, text_col, percent).filter("kept").select(F.col(id_col).alias("_kept_id"))
    return docs.join(kept, docs[id_col] == kept["_kept_id"], "left_semi")
