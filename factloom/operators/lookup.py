"""Looking up earlier chunks of a document for what a chunk leaves open: a top-k join as of a position, and a second pass for doubtful chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.maths import dot, norm
from factloom.operators.dealt import meet
from factloom.shared import settle

#: Characters of a chunk that an answer shows.
EXCERPT = 500


def chunk_lookup(queries: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(document_id, position, rank, chunk_id, content_excerpt, relevance_score): what earlier chunks of the same document say to a query.

    queries: document_id, position (of the chunk that asks), embedding. chunks: document_id, position, id, content, embedding. Only chunks
    at smaller positions are looked at; the ``most`` with the largest cosines stay, ties to the earlier one. The first chunk
    finds nothing. A document with very many chunks is dealt over cells, and each keeps its best before they meet. Null positions, documents and embeddings find nothing and are not found.
    """
    q = queries.filter("embedding is not null and position is not null").select("document_id", F.col("position").alias("asked"), F.col("embedding").alias("qe"), norm(F.col("embedding")).alias("qn"))
    c = chunks.filter("embedding is not null and position is not null").select("document_id", F.col("position").alias("at"), F.col("id").cast("string").alias("chunk_id"), F.substring("content", 1, EXCERPT).alias("content_excerpt"), F.col("embedding").alias("ce"), norm(F.col("embedding")).alias("cn"))
    both = meet(settle(q, "asked"), settle(c, "earlier"), ["document_id"]).filter(F.col("at") < F.col("asked"))
    score = dot(F.col("qe"), F.col("ce")) / F.greatest(F.col("qn") * F.col("cn"), F.lit(1e-12))
    scored = both.select("document_id", F.col("asked").alias("position"), "at", "chunk_id", "content_excerpt", score.alias("relevance_score"))
    w = Window.partitionBy("document_id", "position").orderBy(F.desc("relevance_score"), "at", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("document_id", "position", "rank", "chunk_id", "content_excerpt", "relevance_score")


def lookup_again(first: DataFrame, chunks: DataFrame, mode: str = "auto", below: float = 0.7, most: int = 3) -> DataFrame:
    """First answers (document_id, position, embedding, resolution_confidence, ...) with ``found``, an array of what to look at in a second pass.

    mode ``never``: null for all; ``always``: for every chunk; ``auto``: for those whose confidence is under ``below`` (or null), null for the others, so
    only doubtful chunks cost another call. A chunk without earlier ones gets an empty array.
    """
    if mode not in ("never", "auto", "always"):
        raise ValueError(f"no mode: {mode}")
    doubtful = F.lit(mode == "always") | (F.lit(mode == "auto") & ((F.col("resolution_confidence") < below) | F.col("resolution_confidence").isNull()))
    hits = chunk_lookup(first.filter(doubtful).select("document_id", "position", "embedding"), chunks, most)
    entry = F.struct("rank", "chunk_id", "content_excerpt", "relevance_score")
    hits = hits.groupBy("document_id", "position").agg(F.array_sort(F.collect_list(entry)).alias("_hits"))  # ``most`` entries
    out = first.join(hits, ["document_id", "position"], "left")
    none = F.slice(F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("chunk_id"), F.lit("").alias("content_excerpt"), F.lit(0.0).alias("relevance_score"))), 1, 0)
    return out.withColumn("found", F.when(doubtful, F.transform(F.coalesce("_hits", none), lambda h: h.dropFields("rank")))).drop("_hits")
