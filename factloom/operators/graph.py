"""The property graph as two frames: nodes (node_id, ...) and edges (src, dst, relation_type, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import is_literal


def _united(rows: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """(keys, occurrence_count, lists, confidence): counts summed, ``lists`` (arrays of one type) united, the largest confidence. Entries come one by one, so a key holds distinct ones and not its rows' lists."""
    tagged = lambda c: F.transform(F.coalesce(c, F.array().cast(rows.schema[c].dataType)), lambda x: F.struct(F.lit(c).alias("of"), x.alias("x")))
    own = rows.select(*keys, "occurrence_count", "confidence", F.posexplode_outer(F.concat(*map(tagged, lists))).alias("_at", "_e"))
    once = F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("occurrence_count"))
    return own.groupBy(*keys).agg(F.sum(once).alias("occurrence_count"), *[F.array_sort(F.collect_set(F.when(F.col("_e.of") == c, F.col("_e.x")))).alias(c) for c in lists], F.max("confidence").alias("confidence"))


def build_nodes(triplets: DataFrame, metadata: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of consolidated facts: occurrences, chunks, layer (2, literals 3), largest confidence of an incident edge."""
    ends = triplets.select(*by, "occurrence_count", "source_chunk_ids", "confidence", F.explode(F.array("subject", "object")).alias("node_id"))
    nodes = _united(ends, [*by, "node_id"], ["source_chunk_ids"])
    literal = is_literal(F.col("node_id"))
    nodes = nodes.withColumns({"is_literal": literal, "layer": F.when(literal, 3).otherwise(2)})
    if metadata is not None:
        nodes = nodes.join(metadata.select(F.col("canonical_name").alias("node_id"), "entity_type", "aliases"), "node_id", "left")
        nodes = nodes.withColumn("entity_type", F.when(F.col("aliases").isNull() & F.col("entity_type").isNull() & F.col("is_literal"), "literal").otherwise(F.col("entity_type")))
    return nodes


def build_edges(triplets: DataFrame, nodes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Directed edges of facts whose ends are nodes (semi joins)."""
    edges = triplets.select(*by, F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("relation_type"), "confidence", "occurrence_count", "source_chunk_ids")
    if nodes is not None:
        for end in ("src", "dst"):
            keys = nodes.select(*by, F.col("node_id").alias(end)).distinct()
            edges = edges.join(keys, [*by, end], "left_semi")
    return edges


def attribute_edges(facts: DataFrame) -> DataFrame:
    """Edges from entities to literals: ``measured_at`` where a fact has a time (temporal_scope not blank), else ``has_attribute``.

    facts: subject, object, confidence, temporal_scope. (src, dst, relation_type, occurrence_count, confidence, the largest); facts from a literal or
    to an entity give none.
    """
    timed = F.trim(F.coalesce(F.col("temporal_scope"), F.lit(""))) != ""
    held = facts.filter(is_literal(F.col("object")) & ~is_literal(F.col("subject")))
    rows = held.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.when(timed, "measured_at").otherwise("has_attribute").alias("relation_type"), "confidence")
    return rows.groupBy("src", "dst", "relation_type").agg(F.count("*").alias("occurrence_count"), F.max("confidence").alias("confidence"))


def collapse(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One undirected edge per pair: attributes of the most confident fact (ties: least relation), all relations."""
    pair = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    best = F.min(F.struct((-F.col("confidence")).alias("nc"), "relation_type"))
    out = pair.groupBy(*by, "a", "b").agg(best.alias("_best"), F.array_sort(F.collect_set("relation_type")).alias("relations"), F.sum("occurrence_count").alias("occurrence_count"))
    return out.select(*by, "a", "b", F.col("_best.relation_type").alias("relation_type"), (-F.col("_best.nc")).alias("confidence"), "relations", "occurrence_count")


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) both ways, without loops, each once."""
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u != v")
    return e.union(e.select("v", "u")).distinct()


def classify_layers(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("layer", F.when(F.col("is_literal"), 3).otherwise(2))


def layer_subgraph(nodes: DataFrame, edges: DataFrame, layer: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes of a layer and the edges between them."""
    kept = nodes.filter(F.col("layer") == layer)
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("node_id").alias(end)), end, "left_semi")
    return kept, edges


def layer_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("layer").agg(F.count("*").alias("nodes"), F.sum("occurrence_count").alias("mentions"))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int, relation: str | None = None) -> DataFrame:
    """(start, node, hops): nodes within ``depth`` steps in any direction, with the fewest steps. starts (start).

    One join a step on nodes reached first in the step before.
    """
    use = edges.filter(F.col("relation_type") == relation) if relation else edges
    step = undirected(use)
    reached = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    front = reached
    for k in range(1, depth + 1):
        front = front.select("start", F.col("node").alias("u")).join(step, "u").select("start", F.col("v").alias("node")).distinct()
        front = front.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(k))
        reached = reached.unionByName(front)
    return reached.filter("hops > 0")


def select_nodes(nodes: DataFrame, properties: dict, limit: int | None = None) -> DataFrame:
    """Conjunction of equalities, optionally the first rows by id."""
    out = nodes.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(v) for k, v in properties.items()], F.lit(True)))
    return out.orderBy("node_id").limit(limit) if limit else out


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without ``gone`` (node_id), and edges without those at a dropped end."""
    nodes = nodes.join(gone, "node_id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return nodes, edges


def merge_graph(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental node merge: aliases and chunks united, counts summed, confidence the larger. One union and one aggregate."""
    both = old.unionByName(new, allowMissingColumns=True)
    more = ["aliases"] if "aliases" in both.columns else []
    return _united(both, ["node_id"], ["source_chunk_ids", *more]).select("node_id", "occurrence_count", "source_chunk_ids", "confidence", *more)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental edge merge by (src, relation_type, dst): counts summed, confidence the larger, chunks united."""
    both = old.unionByName(new, allowMissingColumns=True)
    return _united(both, ["src", "relation_type", "dst"], ["source_chunk_ids"]).select("src", "relation_type", "dst", "occurrence_count", "confidence", "source_chunk_ids")


def remove_document(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Provenance-aware delete: chunks (source_chunk_id) of a document go; nodes without any left go with them."""
    rest = nodes.select("node_id", F.explode("source_chunk_ids").alias("source_chunk_id")).join(chunks, "source_chunk_id", "left_anti")
    left = rest.groupBy("node_id").agg(F.array_sort(F.collect_set("source_chunk_id")).alias("source_chunk_ids"))
    return nodes.drop("source_chunk_ids").join(left, "node_id")
