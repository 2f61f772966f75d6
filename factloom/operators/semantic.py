"""Semantic fingerprints: documents whose chunks mean the same, though their words differ.

In each of many random directions a document stands for the chunk that lies furthest out, and that one for its cell of a table of random
hyperplanes; these cells are the document's fingerprint. It doesn't fill up as documents grow: long ones have no more values in common by chance than short ones. Documents that agree in
a band of it, and then in enough of it, are compared by their chunks: the similarity of two is
the mean, over the chunks of both, of the cosine with the nearest chunk of the other. Documents of equal embedding sets are one
class, of which one is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.functions.maths import dot
from factloom.operators.dealt import blocks, meet
from factloom.operators.retrieval import _unit
from factloom.shared import settle

#: Hyperplanes of a table, tables (a direction and a value of a fingerprint each), values of a band, and of those that must agree beyond it.
BITS, VALUES, BAND, AGREE = 7, 192, 3, 30
#: Chunks of a document that is compared row by row, and products (with some for each chunk that is sent) of one cell.
LONG, WORK = 1024, 1 << 24
_SEED = 20240229


def cells(vectors: np.ndarray, values: int = VALUES, bits: int = BITS) -> np.ndarray:
    """For each vector and table how far out it lies in the table's direction (at length one, in 2**-24) and its cell (signs). Tables depend on nothing but the vectors' size."""
    tables = np.random.default_rng(_SEED).standard_normal((vectors.shape[1], values * (bits + 1)))
    out = np.empty((len(vectors), values, 2), np.int64)
    for at in range(0, len(vectors), 512):
        v = vectors[at : at + 512]
        x = (v @ tables).reshape(-1, bits + 1, values)
        out[at : at + 512, :, 0] = np.rint(x[:, 0] / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10) * 2.0**24)
        out[at : at + 512, :, 1] = sum((x[:, i + 1] > 0).astype(np.int64) << i for i in range(bits))
    return out


def minhash(cell: np.ndarray) -> np.ndarray:
    """Values of which the least over a document's vectors is that of the one furthest out; its cell is the last 16 bits."""
    return -cell[..., 0] << 16 | cell[..., 1]


def classes(chunks: DataFrame) -> DataFrame:
    """(document_id, class_id): documents with equal sets of embeddings (document_id, embedding) are one class, named by its least id. Null and empty embeddings don't count."""
    each = chunks.filter("document_id is not null and size(embedding) > 0").select("document_id", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(_SEED), "embedding").alias("g")).distinct()
    # a set is known by its size and two sums of independent hashes, so no list of a document's chunks is gathered
    part = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    sets = each.groupBy("document_id").agg(F.count("*").alias("n"), part("h").alias("a"), part("g").alias("b"))
    return sets.join(sets.groupBy("n", "a", "b").agg(F.min("document_id").alias("class_id")), ["n", "a", "b"]).select("document_id", "class_id")


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(document_id, fingerprint): the least values (``minhash``) of its chunks (document_id, embedding). Minima are taken a batch at a time, then by the shuffle."""
    kind = chunks.schema["document_id"].dataType.simpleString()

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                order = pdf["document_id"].argsort(kind="stable").to_numpy()
                ids = pdf["document_id"].to_numpy()[order]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                v = np.array(pdf["embedding"].iloc[order].tolist(), float)
                least = np.minimum.reduceat(np.concatenate([minhash(cells(v[at : at + 512])) for at in range(0, len(v), 512)]), first, axis=0)
                yield pd.DataFrame({"document_id": ids[first], "m": list(least)})

    parts = chunks.filter("document_id is not null and size(embedding) > 0").select("document_id", "embedding").mapInPandas(signed, f"document_id {kind}, m array<long>")
    best = parts.groupBy("document_id").agg(*[F.min(F.col("m")[i]).alias(f"m{i}") for i in range(VALUES)])
    return best.select("document_id", F.array(*[f"m{i}" for i in range(VALUES)]).alias("fingerprint"))


def _agreeing(kind: pa.DataType):
    """Rows (band, key, _i, _j, _own, id, print) sorted by cell -> (a, b): those of a cell that agree in ``AGREE`` values, in the first of the bands that they share."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        band, key, i, j, own, ids = (t[c].to_numpy() for c in ("band", "key", "_i", "_j", "_own", "id"))
        turn = np.flatnonzero((key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bounds = np.r_[0, turn, n]
        end = np.repeat(bounds[1:], np.diff(bounds))
        values = np.frombuffer(b"".join(t["print"].to_pylist()), np.uint16).reshape(n, VALUES)
        rows, step, found, size = np.arange(n), 1, [], 0
        while len(rows := rows[end[rows] > rows + step]):
            # all rows that have one of their cell so many places further on
            for at in range(0, len(rows), 4096):
                x = rows[at : at + 4096]
                x = x[(i[x] == j[x]) | (own[x] != own[x + step])]
                same = values[x] == values[x + step]
                k = np.flatnonzero(np.count_nonzero(same, axis=1) >= AGREE)
                whole = same[k, 0::BAND]
                for p in range(1, BAND):
                    whole &= same[k, p::BAND]
                x = x[k[~(whole & (np.arange(VALUES // BAND) < band[x[k], None])).any(1)]]
                found.append((x, x + step))
                size += len(x)
            step += 1
            if size > 100_000:
                yield out(ids, found)
                found, size = [], 0
        if size:
            yield out(ids, found)

    def out(ids: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        x, y = (ids[np.concatenate(side)] for side in zip(*found, strict=True))
        less = x < y
        return pa.record_batch([pa.array(np.where(less, x, y), kind), pa.array(np.where(less, y, x), kind)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = t.slice(t.num_rows - 1)
            here = np.logical_and.reduce([t[c].to_numpy() == last[c][0].as_py() for c in ("band", "key", "_i", "_j")])
            cut = int(np.argmax(here))
            yield from solve(t.slice(0, cut)) if cut else ()
            rest = t.slice(cut)
        if rest is not None:
            yield from solve(rest)

    return run


def candidates(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: fingerprints (document_id, fingerprint) that agree in a band and in ``AGREE`` values at least, each pair once.

    The last 16 bits of a value stand for it. Prints meet in the cells of their bands (``dealt.blocks``) and are compared there, so what is
    shuffled are documents by their bands, and pairs only once they agree.
    """
    kind = prints.schema["document_id"].dataType
    packed = F.pandas_udf(lambda s: pd.Series([np.asarray(v).astype(np.uint16).tobytes() for v in s], dtype=object), "binary")
    low = F.transform("fingerprint", lambda v: v.bitwiseAND(F.lit(0xFFFF)))
    known = settle(prints.select(F.col("document_id").alias("id"), packed("fingerprint").alias("print"), low.alias("low")), "packed")

    def key(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for p in range(BAND):
            out = F.shiftleft(out, 16).bitwiseOR(F.get("low", i * BAND + p))
        return out

    bands = F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)), lambda i: F.struct(i.alias("band"), key(i).alias("key")))
    rows = settle(known.select("id", F.explode(bands).alias("x")).select("id", "x.*"), "bands")
    cell = ["band", "key", "_i", "_j"]
    met = settle(blocks(rows, ["band", "key"]), "met").join(known.select("id", "print"), "id").select(*cell, "_own", "id", "print")
    names = kind.simpleString()
    return met.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_agreeing(to_arrow_type(kind)), f"a {names}, b {names}")


def _by_rows(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs found (a, b), a row for each two different chunks (document_id, i, embedding): for documents of very many."""
    unit = F.pandas_udf(lambda s: pd.Series(list(_unit(s))), "array<double>")
    asked = found.select(F.explode(F.array("a", "b")).alias("document_id")).distinct()
    own = settle(chunks.join(asked, "document_id", "left_semi").select("document_id", "i", unit("embedding").alias("v")), "long")
    left = settle(found.join(own.select(F.col("document_id").alias("a"), F.col("i").alias("ia"), F.col("v").alias("va")), "a"), "left")
    both = meet(left, own.select(F.col("document_id").alias("b"), F.col("i").alias("ib"), F.col("v").alias("vb")), ["b"])
    near = settle(both.select("a", "b", "ia", "ib", dot(F.col("va"), F.col("vb")).alias("s")), "near")
    best = lambda i: near.groupBy("a", "b", i).agg(F.max("s").alias("s")).select("a", "b", "s")
    return best("ia").union(best("ib")).groupBy("a", "b").agg(F.avg("s").alias("similarity"))


class _Held:
    """The chunks of a cell's documents: each different vector once, a document's by their numbers."""

    def __init__(self, right: pd.DataFrame):
        code, self.names = pd.factorize(right["document_id"], sort=True)
        order = np.argsort(code, kind="stable")
        v = np.frombuffer(b"".join(right["v"]), float).reshape(len(right), -1)[order]
        _, kept, self.at = np.unique(right["chunk"].to_numpy()[order], return_index=True, return_inverse=True)
        self.v = v[kept]
        if not np.array_equal(self.v[self.at], v):  # two vectors of one hash
            self.v, self.at = v, np.arange(len(v))
        self.first = np.searchsorted(code[order], np.arange(len(self.names) + 1))
        self.count = np.diff(self.first)

    def chunks(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the vectors of docs, one document's after the other's, and where each starts."""
        n = self.count[docs]
        start = np.cumsum(n) - n
        return self.at[np.repeat(self.first[docs] - start, n) + np.arange(n.sum())], start

    def sums(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """For each two documents the sum, over the chunks of the column's, of the cosine with the nearest of the row's. Equal chunks are multiplied once."""
        at, start = self.chunks(rows)
        different, at = np.unique(at, return_inverse=True)
        ends = np.r_[start[1:], len(at)]
        out = np.empty((len(rows), len(columns)))
        before = np.cumsum(self.count[columns]) - self.count[columns]
        wide = max((1 << 21) // max(len(different), len(rows)), 64)
        cut = np.flatnonzero(np.r_[True, before[1:] // wide != before[:-1] // wide])
        for s, e in zip(cut, np.r_[cut[1:], len(columns)], strict=True):
            of, begin = self.chunks(columns[s:e])
            of, place = np.unique(of, return_inverse=True)
            cos = self.v[different] @ self.v[of].T
            best = np.empty((len(rows), len(of)))
            for r, (x, y) in enumerate(zip(start, ends, strict=True)):
                cos[at[x:y]].max(0, out=best[r])
            out[:, s:e] = np.add.reduceat(best[:, place], begin, axis=1)
        return out

    def one_by_one(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarities of pairs sorted by a: a document with as many others at a time as have about 4,096 chunks."""
        out = np.empty(len(a))
        before = np.cumsum(self.count[b]) - self.count[b]
        run = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (before[1:] // 4096 != before[:-1] // 4096)])
        for s, e in zip(run, np.r_[run[1:], len(a)], strict=True):
            at, start = self.chunks(b[s:e])
            sim = self.v[self.chunks(a[s : s + 1])[0]] @ self.v[at].T
            out[s:e] = np.maximum.reduceat(sim, start, axis=1).sum(0) + np.add.reduceat(sim.max(0), start)
        return out


def _compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs (lead, a, b) and the chunks (document_id, chunk, v: a hash and the bytes) of all their documents -> (a, b, similarity)."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": left["a"][:0], "b": left["b"][:0], "similarity": []})
    held = _Held(right)
    a, b = (pd.Index(held.names).get_indexer(left[side]) for side in "ab")
    lead = pd.factorize(left["lead"])[0]
    order = np.lexsort((b, a, lead))
    bounds = np.flatnonzero(np.r_[True, lead[order][1:] != lead[order][:-1], True])
    out = np.empty(len(left))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        of = order[s:e]
        x, y = a[of], b[of]
        rows, i = np.unique(x, return_inverse=True)
        columns, j = np.unique(y, return_inverse=True)
        # most of all the pairs that there can be: each document against all of the other side at once
        if len(rows) > 1 and len(columns) > 1 and len(rows) * len(columns) <= 4 * len(of):
            out[of] = held.sums(rows, columns)[i, j] + held.sums(columns, rows)[j, i]
        else:
            out[of] = held.one_by_one(x, y)
    return pd.DataFrame({"a": left["a"], "b": left["b"], "similarity": out / (held.count[a] + held.count[b])})


def similarity(found: DataFrame, chunks: DataFrame, long: int = LONG, work: int = WORK) -> DataFrame:
    """(a, b, similarity) for pairs of documents, by all their chunks (document_id, embedding), copies of a chunk once.

    Pairs whose first documents have the same least partner come into one cell, or more where they are very many, and a document's chunks go once
    to a cell: groups of documents that are all alike are compared as products of matrices. ``long``: chunks beyond which a document's are compared row by row.
    """
    kind = found.schema["a"].dataType.simpleString()
    packed = F.pandas_udf(lambda s: pd.Series([x.tobytes() for x in _unit(s)], dtype=object), "binary")
    each = chunks.filter("document_id is not null and size(embedding) > 0").select("document_id", F.xxhash64("embedding").alias("i"), "embedding").distinct()
    own = settle(each.select("document_id", "i", packed("embedding").alias("v")), "units")
    sizes = settle(own.groupBy("document_id").agg(F.count("*").alias("n")), "sizes")
    of = lambda side: sizes.select(F.col("document_id").alias(side), F.col("n").alias(f"n{side}"))
    least = found.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("lead"))
    rated = found.join(of("a"), "a").join(of("b"), "b").join(least, "a", "left").select("a", "b", F.coalesce("lead", "a").alias("lead"), "na", "nb", (F.greatest("na", "nb") > long).alias("many"))
    rated = settle(rated, "rated")
    short = rated.filter("not many")
    # products of a group, and what it costs to send its documents' chunks
    sent = sum(F.approx_count_distinct(side) * F.avg(f"n{side}") for side in "ab") * 512
    groups = settle(short.groupBy("lead").agg(F.sum(F.col("na") * F.col("nb") + 8 * (F.col("na") + F.col("nb"))).alias("w"), sent.alias("sent")), "groups")
    total = groups.agg(F.sum(F.col("w") + F.col("sent"))).first()[0] or 0
    sides = groups.select("lead", F.ceil(F.greatest(F.sqrt(F.col("w") / work), F.col("sent") / work)).cast("int").alias("k"))
    spot = F.when(F.col("k") > 1, F.xxhash64("lead")).otherwise(F.pmod(F.xxhash64("lead"), F.lit(int(total // work) + 1)))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
    cell = ["k", "spot", "i", "j"]
    met = settle(short.join(sides, "lead").select("k", spot.alias("spot"), place("a").alias("i"), place("b").alias("j"), "lead", "a", "b"), "cells")
    to = [f"to_{c}" for c in cell]  # names of their own, as both sides come from one frame
    asked = met.select(*cell, "a").union(met.select(*cell, "b")).distinct().toDF(*to, "document_id")
    vectors = asked.join(own.select("document_id", F.col("i").alias("chunk"), "v"), "document_id")
    out = met.groupBy(*cell).cogroup(vectors.groupBy(*to)).applyInPandas(_compare, f"a {kind}, b {kind}, similarity double")
    if sizes.filter(F.col("n") > long).isEmpty():
        return out
    return out.union(_by_rows(rated.filter("many").select("a", "b"), each))


def near_documents(chunks: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(a, b, similarity), a < b: classes of documents (``classes``) whose chunks (document_id, embedding) are alike at ``threshold`` or more.

    Approximate: for two documents whose chunks all have a partner at a cosine of 0.95 the 64 bands find about 97 %, for nearer ones more. What is returned is verified by the embeddings themselves. Documents
    without an embedding have no partner.
    """
    chunks = chunks.select("document_id", "embedding")
    heads = classes(chunks).filter("document_id = class_id").select("document_id")
    chunks = settle(chunks.join(heads, "document_id", "left_semi"), "chunks")
    found = settle(candidates(settle(fingerprints(chunks), "prints")), "candidates")
    return similarity(found, chunks).filter(F.col("similarity") >= threshold)
