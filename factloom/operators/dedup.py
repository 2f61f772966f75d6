"""Fingerprints against a cache of processed documents."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import content_hash, exact_hash, hamming, simhash_of
from factloom.shared import settle, spread

#: A 64-bit hash cut into six blocks: (first bit, bits).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, exact_hash, content_hash, simhash), one row per row of ``docs``. Null counts as the empty text, repeated ids keep their rows."""
    rows = spread(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")))
    out = rows.select(id_col, exact_hash(F.col("_text")).alias("exact_hash"), content_hash(F.col("_text")).alias("content_hash"), simhash_of(F.col("_text")).alias("simhash"))
    return settle(out, "fingerprints")  # used by several levels of a lookup


def duplicates(docs: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(id, keep_id, copies): documents with an equal hash, pre-aggregated to one row a hash and joined back."""
    g = docs.groupBy(hash_col).agg(F.min(id_col).alias("keep_id"), F.count("*").alias("copies"))
    return docs.select(id_col, hash_col).join(g, hash_col).select(id_col, "keep_id", "copies")


def cascade(incoming: DataFrame, cache: DataFrame, id_col: str) -> DataFrame:
    """(id, cache_status, matched_document): exact hash, else content hash, else new."""
    e = cache.groupBy("exact_hash").agg(F.min("document_id").alias("_e"))
    c = cache.groupBy("content_hash").agg(F.min("document_id").alias("_c"))
    j = incoming.join(e, "exact_hash", "left").join(c, "content_hash", "left")
    return j.select(id_col, F.when(F.col("_e").isNotNull(), "exact").when(F.col("_c").isNotNull(), "content").otherwise("new").alias("cache_status"), F.coalesce("_e", "_c").alias("matched_document"))


def _tables(h: Column) -> Column:
    """The keys of a hash in the twenty tables of three blocks each: 31 to 33 bits of it and the table's number."""
    block = [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in BLOCKS]
    keys = []
    for t, chosen in enumerate(combinations(range(len(BLOCKS)), 3)):
        key = F.lit(t).cast("long")
        for b in chosen:
            key = F.shiftleft(key, BLOCKS[b][1]).bitwiseOR(block[b])
        keys.append(key)
    return F.array(*keys)


def near_hashes(left: DataFrame, right: DataFrame, most: int = 3) -> DataFrame:
    """(ha, hb, distance) of 64-bit hashes of two frames (simhash) that differ in at most ``most`` (under 4) bits.

    Three bits touch three of six blocks at most, so such a pair agrees in three blocks, which are the key of one of twenty
    tables. A key holds 31 bits or more: among n unrelated hashes a table has about n * n / 2^31 pairs to look at. Equal hashes, as of
    copies, are one hash here; null ones match nothing. Merged by sorting: a side is twenty times as large as the hashes that
    its size is guessed by, so a broadcast would hold all of its keys on the driver.
    """
    if not 0 <= most <= 3:
        raise ValueError("three of six blocks find distances up to 3")
    cut = lambda df, tag: df.select(F.col("simhash").alias("h")).filter("h is not null").distinct().select(F.col("h").alias(f"h{tag}"), F.explode(_tables(F.col("h"))).alias("key"))
    pairs = cut(left, "a").hint("merge").join(cut(right, "b"), "key").filter(hamming(F.col("ha"), F.col("hb")) <= most).select("ha", "hb").distinct()
    return pairs.withColumn("distance", hamming(F.col("ha"), F.col("hb")))


def near_matches(left: DataFrame, right: DataFrame, most: int = 3) -> DataFrame:
    """(id_a, id_b, distance) of rows (id, simhash) whose hashes differ in at most ``most`` bits: all pairs of rows, so give one row a hash where copies are many."""
    side = lambda df, tag: df.select(F.col("id").alias(f"id_{tag}"), F.col("simhash").alias(f"h{tag}")).hint("merge")
    out = near_hashes(left, right, most).join(side(left, "a"), "ha").join(side(right, "b"), "hb")
    return out.select("id_a", "id_b", "distance")


def cache_lookup(incoming: DataFrame, cache: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(id, hit_level, matched_document, similarity, reusable): exact, content, then structural within ``most`` bits.

    A structural hit takes the nearest entry, then the least document; only the first two levels may be reused.
    """
    # by hash, not by id: ids may repeat, and copies ask once
    e = cache.groupBy("exact_hash").agg(F.min("document_id").alias("_e"))
    c = cache.groupBy("content_hash").agg(F.min("document_id").alias("_c"))
    first = settle(incoming.join(e, "exact_hash", "left").join(c, "content_hash", "left").select(id_col, "simhash", F.when(F.col("_e").isNotNull(), "exact").when(F.col("_c").isNotNull(), "content").otherwise("new").alias("cache_status"), F.coalesce("_e", "_c").alias("matched_document")), "first")
    least = cache.groupBy("simhash").agg(F.min("document_id").alias("id_b"))
    near = near_hashes(first.filter("cache_status = 'new'"), least, most).join(least.withColumnRenamed("simhash", "hb"), "hb")
    near = near.groupBy("ha").agg(F.min(F.struct("distance", "id_b")).alias("b"))
    j = first.join(near.withColumn("cache_status", F.lit("new")).withColumnRenamed("ha", "simhash"), ["simhash", "cache_status"], "left")
    level = F.when(F.col("cache_status") != "new", F.col("cache_status")).when(F.col("b").isNotNull(), "structural").otherwise("none")
    score = F.when(F.col("cache_status") != "new", 1.0).when(F.col("b").isNotNull(), 1 - F.col("b.distance") / 64).otherwise(0.0)
    return j.select(id_col, level.alias("hit_level"), F.coalesce("matched_document", "b.id_b").alias("matched_document"), score.alias("similarity"), (F.col("cache_status") != "new").alias("reusable"))
