"""References of a document linked to graph nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pieces(text, sizes: tuple[int, ...]):
    """The distinct stretches of the given lengths in a lower-cased text."""
    low = F.lower(text)
    none = F.array().cast("array<string>")
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - k + 1, F.lit(1))), lambda i: F.substring(low, i, k))
    return F.array_distinct(F.concat(*[F.when(F.length(low) >= k, of(k)).otherwise(none) for k in sizes]))


def _containing(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): where the one stands in the other, without regard to case.

    Each small text looks only under its rarest piece (three letters, or all of a shorter text), so common
    endings don't bring everything together; a piece that no large text has settles it at once.
    """
    index = large.distinct().select("large", F.explode(_pieces(F.col("large"), (1, 2, 3))).alias("piece"))
    known = index.groupBy("piece").agg(F.count("*").alias("n"))
    size = F.least(F.length("small"), F.lit(3))
    own = F.when(size == 3, _pieces(F.col("small"), (3,))).otherwise(F.array(F.lower("small")))
    asked = small.distinct().filter("small != ''").select("small", F.explode(own).alias("piece")).join(known, "piece", "left")
    rarest = asked.groupBy("small").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("piece", F.struct("n", "piece")).alias("piece")).filter("least > 0")
    return rarest.join(index, "piece").filter(F.contains(F.lower("large"), F.lower("small"))).select("small", "large")


def match_nodes(texts: DataFrame, nodes: DataFrame, aliases: DataFrame, substrings: bool = True) -> DataFrame:
    """(text, node_id): the node of that name, else of that alias, else the first by ``ord`` that contains it or is contained.

    nodes: node_id, ord. aliases: alias, canonical. The first two are equi-joins; only texts they
    leave open meet the nodes for substrings, in either direction. Empty texts match nothing.
    """
    t = texts.select("text").distinct()
    exact = t.join(nodes.select(F.col("node_id").alias("text"), F.col("node_id").alias("_e")), "text", "left")
    low = aliases.select(F.lower("alias").alias("_a"), F.col("canonical").alias("_c")).dropDuplicates(["_a"])
    low = low.join(nodes.select(F.col("node_id").alias("_c")), "_c", "left_semi")
    out = exact.join(low, F.lower("text") == F.col("_a"), "left").select("text", F.coalesce("_e", "_c").alias("_n"))
    if not substrings:
        return out.select("text", F.col("_n").alias("node_id"))
    open_ = out.filter("_n is null").select("text")
    names = nodes.select(F.col("node_id").alias("name"))
    inside = _containing(open_.withColumnRenamed("text", "small"), names.withColumnRenamed("name", "large")).select(F.col("small").alias("text"), F.col("large").alias("node_id"))
    around = _containing(names.withColumnRenamed("name", "small"), open_.withColumnRenamed("text", "large")).select(F.col("large").alias("text"), F.col("small").alias("node_id"))
    fit = inside.union(around).distinct().join(nodes.select("node_id", "ord"), "node_id")
    first = fit.groupBy("text").agg(F.min_by("node_id", "ord").alias("_s"))
    return out.join(first, "text", "left").select("text", F.coalesce("_n", "_s").alias("node_id"))


def link_references(refs: DataFrame, nodes: DataFrame, aliases: DataFrame, substrings: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new edges) of references (seq, type, text, target, source_chunk_id).

    Bibliography entries become nodes first; citations then give ``cites`` edges of 0.8 (from the
    document where the citing text is no node), internal references ``references`` edges of 0.7. One
    edge for a pair of ends, the first by seq. Footnotes give nothing.
    """
    name = F.coalesce("target", F.substring("text", 1, 80))
    bib = refs.filter("type = 'bibliography'").select(name.alias("node_id"), "seq", "source_chunk_id").groupBy("node_id").agg(F.min_by("source_chunk_id", "seq").alias("source_chunk_id"), F.min("seq").alias("seq"))
    bib = bib.join(nodes.select("node_id"), "node_id", "left_anti")
    known = nodes.select("node_id", "ord").unionByName(bib.select("node_id", (F.col("seq") + 1_000_000_000).alias("ord")))
    r = refs.filter("type in ('citation', 'internal_ref') and target is not null")
    found = match_nodes(r.select("text").union(r.select(F.col("target"))), known, aliases, substrings)
    j = r.join(found.toDF("text", "_src"), "text").join(found.toDF("target", "_dst"), "target").filter("_dst is not null")
    j = j.withColumn("_src", F.when(F.col("type") == "citation", F.coalesce("_src", F.lit("document"))).otherwise(F.col("_src"))).filter("_src is not null and (type = 'citation' or _src != _dst)")
    edge = F.struct("seq", F.when(F.col("type") == "citation", "cites").otherwise("references").alias("relation_type"), F.when(F.col("type") == "citation", 0.8).otherwise(0.7).alias("confidence"), "source_chunk_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    edges = j.groupBy(F.least("_src", "_dst").alias("a"), F.greatest("_src", "_dst").alias("b")).agg(F.min(edge).alias("e")).select("e.src", "e.dst", "e.relation_type", "e.confidence", "e.source_chunk_id")
    return bib.drop("seq"), edges
