"""Entity clusters and links between a corpus and new entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.dealt import CELL


def leader_clusters(entities: DataFrame, threshold: float = 0.85, by: str = "document_id") -> DataFrame:
    """(by, name, leader): names in order; each unclaimed one leads and claims later ones with cosine >= threshold to itself.

    The sweep depends on its order, so it runs per document (``applyInPandas``): each step is one matrix
    product of a leader with the names not yet claimed, never a full matrix.
    """

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("name").sort_values("name", ignore_index=True)
        v = np.array(pdf["embedding"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
        leader = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            if leader[i] < 0:
                rest = np.flatnonzero(leader[i:] < 0) + i
                claimed = rest[(v[rest] @ v[i] >= threshold) | (rest == i)]
                leader[claimed] = i
        return pd.DataFrame({by: pdf[by], "name": pdf["name"], "leader": pdf["name"].to_numpy()[leader]})

    kind = entities.schema[by].dataType.simpleString()
    return entities.select(by, "name", "embedding").groupBy(by).applyInPandas(sweep, f"{by} {kind}, name string, leader string")


def canonical_names(clusters: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, canonical, aliases): the longest name of a cluster, the first in order on ties, and the other names."""
    best = F.min(F.struct((-F.length("name")).alias("n"), "name"))["name"]
    g = clusters.groupBy(by, "leader").agg(best.alias("canonical"), F.array_sort(F.collect_set("name")).alias("names"))
    return g.select(by, "canonical", F.array_remove("names", F.col("canonical")).alias("aliases"))


def link_by_name(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(canonical_name, target, how): the first hit of name, then alias by alias, against known names, then known aliases.

    Both inputs: canonical_name, aliases. Comparisons ignore case. Unlinked entities have a null target.
    """
    names = existing.select(F.lower("canonical_name").alias("key"), F.col("canonical_name").alias("target"), F.lit(0).alias("side"))
    aliases = existing.select(F.explode(F.transform("aliases", F.lower)).alias("key"), F.col("canonical_name").alias("target"), F.lit(1).alias("side"))
    index = names.union(aliases).groupBy("key", "side").agg(F.max("target").alias("target"))
    tried = incoming.select("canonical_name", F.posexplode(F.concat(F.array("canonical_name"), "aliases")).alias("ord", "form")).withColumn("key", F.lower("form"))
    hits = tried.join(index, "key").groupBy("canonical_name").agg(F.min(F.struct("ord", "side", "target")).alias("b"))
    out = incoming.select("canonical_name").join(hits, "canonical_name", "left")
    how = F.when(F.col("b.ord") > 0, "incoming alias").when(F.col("b.side") == 0, "name").when(F.col("b.side") == 1, "alias")
    return out.select("canonical_name", F.col("b.target").alias("target"), how.alias("how"))


def nearest(left: DataFrame, right: DataFrame, threshold: float, small: int = 20_000) -> DataFrame:
    """(left_id, right_id, similarity): the best cosine of each left vector, ties to the least id, if it reaches the threshold.

    left and right: id, embedding. A right side of at most ``small`` rows (counted) goes to every task
    once and each batch is one matrix product. A larger right side is cut into blocks of that size; every left row meets
    each block, and the best of the blocks is taken: exact, and the product of both sides. ``vectors.nearest`` looks into lists instead.
    """
    rows = right.count()
    blocks = max(1, -(-rows // small))
    spark = left.sparkSession
    best = None
    right = right.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    kind = right.schema["id"].dataType.simpleString()
    for k in range(blocks):
        part = right.filter(F.col("_b") == k).orderBy("id").select("id", "embedding").toPandas()  # about ``small`` rows
        known = spark.sparkContext.broadcast((part["id"].to_numpy(), _unit(part["embedding"])))

        def match(batches, known=known):
            ids, v = known.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                own, at, best = _unit(pdf["embedding"]), np.empty(len(pdf), np.int64), np.empty(len(pdf))
                for i, j in slices(len(pdf), len(v)):
                    sim = own[i:j] @ v.T
                    at[i:j] = sim.argmax(1)
                    best[i:j] = sim[np.arange(j - i), at[i:j]]
                yield pd.DataFrame({"left_id": pdf["id"], "right_id": ids[at], "similarity": best})

        found = left.select("id", "embedding").mapInPandas(match, f"left_id {left.schema['id'].dataType.simpleString()}, right_id {kind}, similarity double")
        best = found if best is None else best.unionByName(found)
    top = best.groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "right_id")).alias("b"))
    return top.select("left_id", F.col("b.right_id").alias("right_id"), (-F.col("b.s")).alias("similarity")).filter(F.col("similarity") >= threshold)


def slices(rows: int, others: int, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of ``rows`` whose products with ``others`` have about ``most`` values (8 MB), at least a row each."""
    step = max(1, most // max(others, 1))
    return ((i, min(i + step, rows)) for i in range(0, rows, step))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(column: pd.Series) -> np.ndarray:
    v = _matrix(column)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)


def link(existing: DataFrame, incoming: DataFrame, threshold: float = 0.88, find=None) -> DataFrame:
    """Names and aliases first, then the nearest embedding of what is left. Inputs: canonical_name, aliases, embedding.

    find: ``nearest`` (exact, all pairs in blocks) or, for large sides, ``vectors.nearest`` (by lists).
    """
    named = link_by_name(existing, incoming)
    rest = incoming.join(named.filter("target is null").select("canonical_name"), "canonical_name", "left_semi")
    near = (find or nearest)(rest.select(F.col("canonical_name").alias("id"), "embedding"), existing.select(F.col("canonical_name").alias("id"), "embedding"), threshold)
    near = near.select(F.col("left_id").alias("canonical_name"), F.col("right_id").alias("_t"))
    return named.join(near, "canonical_name", "left").select("canonical_name", F.coalesce("target", "_t").alias("target"), F.coalesce("how", F.when(F.col("_t").isNotNull(), "embedding")).alias("how"))


def similar_pairs(rows: DataFrame, threshold: float, block_col: str, cell: int = CELL) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, within blocks (block_col, not null): rows whose cosine reaches the threshold.

    A block's rows are cut into cells; each two of its cells are a task's matrix product, taken by stretches. Exact, so its work is the square of a block.
    Vectors of different sizes and those with a null in them are alike to none.
    """
    own = rows.filter(F.col(block_col).isNotNull() & F.col("embedding").isNotNull()).select("id", F.col(block_col).alias("b"), "embedding", F.size("embedding").alias("z"))
    cells = own.groupBy("b", "z").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"))
    own = own.join(cells, ["b", "z"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    own = own.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).select("b", "z", "i", "j", "own", "id", "embedding")
    kind = rows.schema["id"].dataType.simpleString()

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        one = pdf["i"][0] == pdf["j"][0]
        first, last = (pdf, pdf) if one else (pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]])
        p, q = first["id"].to_numpy(), last["id"].to_numpy()
        v, w = _matrix(first["embedding"]), _matrix(last["embedding"])
        nv, nw = (np.maximum(np.linalg.norm(x, axis=1), 1e-10) for x in (v, w))
        found = []
        for i, j in slices(len(v), len(w)):
            sim = (v[i:j] @ w.T) / (nv[i:j, None] * nw)
            x, y = np.nonzero(sim >= threshold)
            found.append((p[x + i], q[y], sim[x, y]))
        a, b, s = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        kept = a < b if one else a != b
        a, b, s = a[kept], b[kept], s[kept]
        return pd.DataFrame({"id_a": np.where(a < b, a, b), "id_b": np.where(a < b, b, a), "similarity": s})

    return own.groupBy("b", "z", "i", "j").applyInPandas(product, f"id_a {kind}, id_b {kind}, similarity double")
