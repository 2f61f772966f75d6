"""Nearest vectors by inverted lists: every vector lies in the list of its nearest centre, a query looks into a few lists.

Centres come from a bounded sample; how many lists a query has to look into is measured on it, so that the wanted
recall is reached on data of this kind. All vectors are indexed. Lists meet their queries in
cells of bounded size, so a list that holds a third of all vectors is many tasks' work, and nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.retrieval import _unit
from factloom.shared import settle

#: Vectors that centres are fitted on, queries that recall is measured with, rows of one side of a cell.
SAMPLE, ASKED, CELL = 20_000, 200, 4096


@dataclass(frozen=True)
class Lists:
    centres: np.ndarray
    probes: int
    #: Share of the true neighbours, among the sample, that ``probes`` lists held.
    recall: float

    def order(self, v: np.ndarray) -> np.ndarray:
        return np.argsort(-(v @ self.centres.T), axis=1, kind="stable")


def _centres(v: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from rows at even distances."""
    c = v[np.linspace(0, len(v) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-10), c)
    return c


def fit(vectors: DataFrame, k: int = 10, recall: float = 0.95, lists: int | None = None, sample: int = SAMPLE, asked: int = ASKED) -> Lists | None:
    """Centres and the number of probes for ``recall`` on a sample of ``sample`` vectors (id, embedding), the first by a hash of their id; None without vectors."""
    rows = vectors.select("id", "embedding").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).toPandas()  # bounded by the limit
    if not len(rows):
        return None
    n = vectors.count()
    v = _unit(rows["embedding"])
    count = max(1, min(lists or int(np.sqrt(n)), len(v), 4096))
    c = _centres(v, count)
    own = (v @ c.T).argmax(1)
    q = v[:asked]
    sim = q @ v.T
    true = np.argsort(-sim, axis=1, kind="stable")[:, : k + 1]  # with the query itself, which every search finds
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(count)[None, :].repeat(len(q), 0), 1)
    rank = np.take_along_axis(place, own[true], 1)[:, 1:] if true.shape[1] > 1 else np.zeros((len(q), 1), int)
    held = np.cumsum(np.bincount(rank.ravel(), minlength=count)) / max(rank.size, 1)
    probes = int(np.argmax(held >= recall)) + 1
    return Lists(c, probes, float(held[probes - 1]))


def search(queries: DataFrame, vectors: DataFrame, k: int, index: Lists | None = None, recall: float = 0.95) -> DataFrame:
    """(query_id, id, score, rank): as ``retrieval.top_k``, but looked for in the nearest lists only.

    queries: query_id, embedding. vectors: id, embedding. Without an index one is fitted first.
    """
    spark = vectors.sparkSession
    qkind, vkind = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    index = index or fit(vectors, k, recall)
    if index is None:
        return spark.createDataFrame([], f"query_id {qkind}, id {vkind}, score double, rank int")
    v = settle(placed(vectors.select("id", "embedding"), index, 1), "lists")
    q = settle(placed(queries.select("query_id", "embedding"), index, index.probes), "asked")
    return meet_lists(q, v, k)


def placed(rows: DataFrame, index: Lists, first: int) -> DataFrame:
    """rows (a key, embedding) in their ``first`` nearest lists: a row each, with the column ``list``."""
    known = rows.sparkSession.sparkContext.broadcast(index)  # at most 4096 centres
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                best = known.value.order(_unit(pdf["embedding"]))[:, :first]
                yield pdf.loc[pdf.index.repeat(best.shape[1])].assign(list=best.ravel())

    return rows.mapInPandas(place, f"{kinds}, list long")


def meet_lists(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of v (id, embedding, list) to each query (query_id, embedding, list) in the lists that it asks."""
    qkind, vkind = q.schema["query_id"].dataType.simpleString(), v.schema["id"].dataType.simpleString()
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    sizes = blocks(v, "nv").join(blocks(q, "nq"), "list")
    of = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("string")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(sizes, "list").withColumn("bv", of("id", "nv")).withColumn("bq", every("nq")).select("list", "bv", "bq", "id", "embedding")
    q = q.join(sizes, "list").withColumn("bq", of("query_id", "nq")).withColumn("bv", every("nv")).select("list", "bv", "bq", "query_id", "embedding")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        right = right.sort_values("id", ignore_index=True)
        sim = _unit(left["embedding"]) @ _unit(right["embedding"]).T
        keep = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), keep.shape[1]), "id": right["id"].to_numpy()[keep.ravel()], "score": np.take_along_axis(sim, keep, 1).ravel()})

    cell = ["list", "bv", "bq"]
    found = q.groupBy(*cell).cogroup(v.groupBy(*cell)).applyInPandas(meet, f"query_id {qkind}, id {vkind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, threshold: float, index: Lists | None = None, recall: float = 0.95) -> DataFrame:
    """(left_id, right_id, similarity): as ``entities.nearest``, by lists."""
    found = search(left.select(F.col("id").alias("query_id"), "embedding"), right, 1, index, recall)
    return found.select(F.col("query_id").alias("left_id"), F.col("id").alias("right_id"), F.col("score").alias("similarity")).filter(F.col("similarity") >= threshold)
