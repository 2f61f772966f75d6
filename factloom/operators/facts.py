"""Raw facts to consolidated facts: entity mentions, relation taxonomy, grouping.

Input facts: document_id, seq, subject, predicate, object, source_chunk_id, confidence and, optionally,
context_sentence, qualifiers map<string,string>, temporal_scope struct with granularity.
``seq`` carries the order that first-wins rules need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.maths import boosted
from factloom.functions.text import slug


def taxonomy(spark: SparkSession) -> DataFrame:
    """(ord, canonical, category, directional, form): one row per lower-cased surface form or name."""
    rows = [(i, c, cat, d, f) for i, (c, cat, d, forms) in enumerate(fixed.RELATIONS) for f in dict.fromkeys([*(x.lower() for x in forms), c])]
    return spark.createDataFrame(rows, "ord int, canonical string, category string, directional boolean, form string")


def canonical_relation(predicate: Column, extensible: bool = True) -> Column:
    """First taxonomy entry whose forms or name equal the lower-cased predicate; else its slug, or related_to.

    The taxonomy is fixed and small, so it is a literal map inside the projection: no join.
    """
    first: dict[str, str] = {}
    for c, _, _, forms in fixed.RELATIONS:
        for f in [*forms, c]:
            first.setdefault(f.lower(), c)
    table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(predicate))), slug(predicate) if extensible else F.lit("related_to"))


def relation_mapping(facts: DataFrame, extensible: bool = True) -> DataFrame:
    """(predicate, canonical) for each distinct raw predicate."""
    return facts.select("predicate").distinct().select("predicate", canonical_relation(F.col("predicate"), extensible).alias("canonical"))


def extended_taxonomy(facts: DataFrame) -> DataFrame:
    """Base entries and one ``extended`` entry per slug of an unknown predicate, with its sorted forms."""
    spark = facts.sparkSession
    base = taxonomy(spark)
    unknown = facts.select("predicate").distinct().join(F.broadcast(base.select("form").distinct()), F.trim(F.lower("predicate")) == F.col("form"), "left_anti")  # a fixed table of forms
    new = unknown.groupBy(slug(F.col("predicate")).alias("canonical")).agg(F.array_sort(F.collect_set("predicate")).alias("forms")).select("canonical", F.lit("extended").alias("category"), F.lit(True).alias("directional"), "forms")
    known = spark.createDataFrame([(c, cat, d, forms) for c, cat, d, forms in fixed.RELATIONS], "canonical string, category string, directional boolean, forms array<string>")
    return known.unionByName(new)


def entity_mentions(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(entity, occurrence_count, source_chunk_ids) over trimmed, non-empty subjects and objects."""
    both = facts.select(*by, "source_chunk_id", F.explode(F.array(F.trim("subject"), F.trim("object"))).alias("entity")).filter("entity != ''")
    return both.groupBy(*by, "entity").agg(F.count("*").alias("occurrence_count"), F.array_sort(F.collect_set("source_chunk_id")).alias("source_chunk_ids"))


def substitute(facts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Trimmed names, aliases (alias, canonical) replaced, predicates canonical; the raw predicate stays as ``form``."""
    out = facts.withColumns({"subject": F.trim("subject"), "object": F.trim("object"), "form": F.trim("predicate"), "predicate": canonical_relation(F.col("predicate"))})
    if aliases is not None:
        for c in ("subject", "object"):
            named = aliases.select(F.col("alias").alias(f"_{c}"), F.col("canonical").alias(f"_{c}_to"))
            out = out.join(named, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_{c}_to", c)).drop(f"_{c}", f"_{c}_to")
    return out


def consolidate(facts: DataFrame, aliases: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Group facts that agree in lower-cased, trimmed subject, predicate and object.

    The casing and the order of sentences are those of the first row by ``seq``; confidence is the
    largest, boosted by repetition. One shuffle, partially aggregated.
    """
    f = substitute(facts, aliases)
    key = [F.lower(F.trim(c)).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    aggs = [
        F.min_by(F.struct("subject", "predicate", "object"), "seq").alias("_first"),
        F.array_sort(F.collect_set("source_chunk_id")).alias("source_chunk_ids"),
        F.count("*").alias("occurrence_count"),
        F.max("confidence").alias("_confidence"),
        F.array_sort(F.collect_set("form")).alias("original_forms"),
    ]
    if "context_sentence" in f.columns:
        told = F.filter(F.array_sort(F.collect_list(F.struct("seq", "context_sentence"))), lambda x: x["context_sentence"].isNotNull() & (x["context_sentence"] != ""))
        aggs.append(F.array_distinct(F.transform(told, lambda x: x["context_sentence"])).alias("context_sentences"))
    if "temporal_scope" in f.columns:
        rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.GRANULARITY.items() for x in kv]), F.col("temporal_scope.granularity")), F.lit(0))
        aggs.append(F.max_by("temporal_scope", F.when(F.col("temporal_scope").isNotNull(), F.struct(rank.alias("r"), (-F.col("seq")).alias("s")))).alias("temporal_scope"))
    out = f.groupBy(*by, *key).agg(*aggs)
    extra = [c for c in ("context_sentences", "temporal_scope") if c in out.columns]
    return out.select(*by, "_first.subject", "_first.predicate", "_first.object", "source_chunk_ids", "occurrence_count", boosted(F.col("_confidence"), F.col("occurrence_count")).alias("confidence"), "original_forms", *extra)


def merge_qualifiers(facts: DataFrame, by: tuple[str, ...] = ("subject", "predicate", "object")) -> DataFrame:
    """(by, qualifiers map<string, array<string>>): distinct values of each key in the order they came."""
    rows = facts.select(*by, "seq", F.explode("qualifiers").alias("k", "v"))
    per_key = rows.groupBy(*by, "k").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"])).alias("vs"))
    return per_key.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "vs")))).alias("qualifiers"))


def merge_stats(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: facts, distinct entities and relations before and after, share of facts removed."""
    count = lambda f, tag: f.agg(F.count("*").alias(f"facts_{tag}"), F.count_distinct("predicate").alias(f"relations_{tag}")).crossJoin(  # one row each
        f.select(F.explode(F.array(F.trim("subject"), F.trim("object"))).alias("e")).agg(F.count_distinct("e").alias(f"entities_{tag}"))
    )
    both = count(raw, "before").crossJoin(count(merged, "after"))
    return both.withColumn("dedup_ratio", F.round(1 - F.col("facts_after") / F.greatest("facts_before", F.lit(1)), 4))


def merge(raw: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The three passes: entity clusters (canonical, aliases), relation taxonomy, consolidation."""
    aliases = clusters.select("canonical", F.explode("aliases").alias("alias")) if clusters is not None else None
    return consolidate(raw, aliases)
