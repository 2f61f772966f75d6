"""What an analysis leaves in the stores: four collections of vectors, the graph, and views of entities and facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import indexable
from factloom.shared import settle
from factloom.sources.stores import GraphStore, VectorStore

#: Collection -> (id column, columns of the text, columns of the metadata)
COLLECTIONS = {
    "chunks": ("chunk_id", ("content", "context_summary", "global_summary"), ("document_id", "chunk_index", "section_title", "page_number")),
    "entity_profiles": ("canonical_name", ("profile_text",), ("entity_type",)),
    "relation_profiles": ("relation_id", ("profile_text",), ()),
    "community_summaries": ("community_id", ("summary",), ("level",)),
}


def metadata(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """A map of the given columns that are there and not null, as strings."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns if c in rows.columns]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def entries(rows: DataFrame, collection: str) -> DataFrame:
    """(id, document, metadata) of one collection's rows; rows without an id or text are left out."""
    key, texts, extra = COLLECTIONS[collection]
    text = indexable(*[F.col(c) for c in texts if c in rows.columns])
    return rows.select(F.col(key).cast("string").alias("id"), text.alias("document"), metadata(rows, extra).alias("metadata")).filter("id is not null and document != ''")


def index_analysis(outputs: dict[str, DataFrame], embed: Callable[[Column], Column], vectors: VectorStore | None = None, graph: GraphStore | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> dict:
    """Puts the collections that are given, and the graph, into the stores; a part that fails is reported and the others go on.

    Returns counts by collection, graph_nodes, graph_edges and errors.
    """
    report: dict = {c: 0 for c in COLLECTIONS} | {"graph_nodes": 0, "graph_edges": 0, "errors": []}
    for name, rows in outputs.items():
        if vectors is None:
            break
        try:
            ready = settle(entries(rows, name).withColumn("embedding", embed(F.col("document"))), "entries")
            vectors.upsert(name, ready)
            report[name] = ready.select("id").distinct().count()
        except Exception as e:  # noqa: BLE001 - reported
            report["errors"].append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    if graph is not None and nodes is not None and edges is not None:
        try:
            graph.import_graph(nodes, edges)
            report["graph_nodes"], report["graph_edges"] = nodes.count(), edges.count()
        except Exception as e:  # noqa: BLE001 - reported
            report["errors"].append(f"graph: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    return report


def concepts(nodes: DataFrame) -> DataFrame:
    """Nodes as concepts: name, type, aliases, mentions, confidence; literals are none."""
    have = nodes.columns
    kind = F.coalesce("entity_type", F.lit("concept")) if "entity_type" in have else F.lit("concept")
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in have else F.array().cast("array<string>")
    return nodes.filter("not is_literal").select(F.col("node_id").alias("name"), kind.alias("type"), aliases.alias("aliases"), F.col("occurrence_count").alias("mentions"), "confidence")


def relations(triplets: DataFrame) -> DataFrame:
    """Consolidated facts as relations: source, relation, target, confidence, occurrences."""
    return triplets.select(F.col("subject").alias("source"), F.col("predicate").alias("relation"), F.col("object").alias("target"), "confidence", F.col("occurrence_count").alias("occurrences"))
