"""Variants of documents by their sections: anchors, and which documents hold most of another's.

A section's anchor hashes its title and its first and last sentence; the set of a document's anchors is its constellation. A document is a variant of a
larger one (a new edition, an excerpt) if the larger one holds at least ``share`` of its anchors. To find all such pairs without comparing documents:
of a constellation of n anchors that shares m with another, any n - m + 1 hold a shared one, so the smaller document looks only under its
rarest n - m + 1. Anchors that very many documents have are looked under by documents of hardly any others, and such keys are dealt over cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.dealt import meet
from factloom.shared import settle


def anchor(title: Column, content: Column) -> Column:
    """16 hex digits of a section: its title, first and last sentence, in lower case; the separator is no character of a sentence."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    text = plain(content)
    # the last sentence is looked for from the end: from the start, each character of a sentence before it was tried to its end
    first, last = F.regexp_extract(text, r"^[^.!?]*+[.!?]*+", 0), F.regexp_extract(text, r"(?s)^(?:.*[.!?](?=[^.!?]))?(.*)\z", 1)
    return F.substring(F.sha2(F.concat_ws("\n", plain(title), F.trim(first), F.trim(last)).cast("binary"), 256), 1, 16)


def constellations(sections: DataFrame) -> DataFrame:
    """(document_id, anchors): sorted distinct anchors of sections (document_id, title, content). Sections without a title and text say nothing."""
    told = sections.filter((F.trim(F.coalesce("title", F.lit(""))) != "") | (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return told.filter("document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set(anchor(F.col("title"), F.col("content")))).alias("anchors"))


def classes(documents: DataFrame) -> DataFrame:
    """(document_id, class_id, anchors): documents of equal constellations (document_id, anchors) are one class, named by its least id."""
    least = documents.groupBy("anchors").agg(F.min("document_id").alias("class_id"))
    return documents.join(least, "anchors").select("document_id", "class_id", "anchors")


def variants(documents: DataFrame, share: float = 0.7) -> DataFrame:
    """(small_id, large_id, shared, share) between classes of constellations: the larger holds at least ``share`` of the smaller one's anchors.

    documents: document_id, anchors (distinct). Of two of equal size the smaller id is ``small_id``. Empty constellations match nothing. Members of a class
    are in ``classes``; copies are not compared. A repeated id is a document of its own constellation each time.
    """
    sets = settle(documents.filter(F.size("anchors") > 0).groupBy("anchors").agg(F.min("document_id").alias("id")).select("id", F.size("anchors").alias("n"), "anchors"), "classes")
    rows = settle(sets.select("id", "n", F.explode("anchors").alias("anchor")), "anchors")
    common = rows.groupBy("anchor").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("id").orderBy("held", "anchor")
    # counts that a product rounds up by its last bit are taken down again: 0.7 * 10 is 7, not 8
    least = F.ceil(F.round(F.lit(share) * F.col("n"), 9))
    ask = rows.join(common, "anchor").withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= F.col("n") - least + 1)
    ask = settle(ask.select("anchor", F.col("id").alias("small_id"), F.col("n").alias("small_n")), "asked")
    larger = (F.col("small_n") < F.col("large_n")) | ((F.col("small_n") == F.col("large_n")) & (F.col("small_id") < F.col("large_id")))
    found = meet(ask, rows.select("anchor", F.col("id").alias("large_id"), F.col("n").alias("large_n")), ["anchor"]).filter(larger)
    found = settle(found.select("small_id", "large_id").distinct(), "candidates")
    # anchors go to a candidate as one array, so a pair is checked in its row
    both = found.join(sets.select(F.col("id").alias("small_id"), F.col("n").alias("small_n"), F.col("anchors").alias("x")), "small_id").join(sets.select(F.col("id").alias("large_id"), F.col("anchors").alias("y")), "large_id")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y"))).withColumn("share", F.col("shared") / F.col("small_n"))
    return both.filter(F.col("share") >= share).select("small_id", "large_id", F.col("shared").cast("long").alias("shared"), "share")
