"""A training corpus in five stages, each on all that the one before it kept.

Quality classifier, exact dedup, near-dedup, benchmark decontamination, subword encoding with a
decoded copy. ``run(spark, sf_dir)`` applies them to ``documents``; every stage's result is written as Parquet to the
shared folder and read again by the next, so a lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import quality
from factloom.llm.decontaminate import drop_leaks
from factloom.llm.exact_dedup import drop_exact_duplicates
from factloom.llm.minhash import drop_near_duplicates
from factloom.llm.pieces import encode_decoded
from factloom.llm.toxicity import keep_scored
from factloom.shared import settle, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores 0.3 or more as good stay."""
    return keep_scored(quality.fit(docs, table(spark, sf_dir, "labels")), docs, 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the one with the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces (one sampled segmentation, drawn by doc_id), n_pieces, the decoded text, lang, source, n_chars."""
    keep = tuple(c for c in ("lang", "source", "n_chars") if c in docs.columns)
    return encode_decoded(docs, keep=keep).select("doc_id", "text", *keep, "pieces", F.size("pieces").alias("n_pieces"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: A field of learnt weights and sampled segmentations aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
