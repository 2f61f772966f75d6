"""A graph store rebuilt from the node-link files that runs left, and brought up to date as files come and change.

A file is what one document says. Its nodes and edges are kept as rows of that document (parts), in buckets by document, and a node or edge of the
graph is an aggregate over its parts; so a file that is read twice counts once, a newer run of a document takes the place of the older one, and what other
documents say stays. Files are taken in batches. Before a batch changes anything it writes down which nodes and edges it
will touch; a run that was killed is repeated from there, and the outcome is as if nothing had happened.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shared import settle
from factloom.sources.stores import Files, GraphStore, Table

#: Where runs leave their graphs: document, run.
LAYOUT = r"([^/]+)/runs/([^/]+)/04_synthesis/graph\.json$"
GRAPH = (
    "nodes array<struct<id:string,occurrence_count:long,confidence:double,layer:int>>,"
    "links array<struct<source:string,target:string,relation_type:string,occurrence_count:long,confidence:double>>"
)
NODE, EDGE = ["node_id"], ["src", "relation_type", "dst"]


#: Tasks that list folders, for each core.
LISTERS = 4


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by few tasks: Spark starts one for each (10,000 at most), which costs far more than a folder of one file."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Parts(Table):
    """Rows by document; all rows of a document are replaced together."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        super().__init__(spark, path, ["document_id"], buckets)

    def replace(self, documents: DataFrame, rows: DataFrame) -> None:
        version = self._version()
        touched = self._touched(documents)
        if version["n"] >= 0:
            rows = self._read(version, touched).join(documents.select("document_id"), "document_id", "left_anti").unionByName(rows)
        self._put(version, rows, touched)


def _summed(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("occurrence_count").alias("occurrence_count"), F.max("confidence").alias("confidence"), *more)


class Rebuild:
    """The graph (``graph``, a GraphStore) of all files under a folder.

    Nodes: node_id, layer (the least that a file gives), occurrence_count (sum), confidence (largest), corroboration (documents that hold it). Edges: src,
    relation_type, dst and the same counts. Which documents those are is in ``documents_of``, as rows, for a hub has very many. Missing counts are 1, missing confidences 0. Nodes
    without an id and edges without both ends and a relation are left out. A file that isn't a JSON object counts as empty and has an error in ``files``.
    """

    def __init__(self, spark: SparkSession, path: str, layout: str = LAYOUT, buckets: int = 32):
        self.spark, self.path, self.layout = spark, path, layout
        self.files = Table(spark, f"{path}/files", ["document_id"], buckets)
        self.parts = {"nodes": _Parts(spark, f"{path}/node_parts", buckets), "edges": _Parts(spark, f"{path}/edge_parts", buckets)}
        self.graph = GraphStore(spark, f"{path}/graph")

    def scan(self, root: str, name: str = "graph.json") -> DataFrame:
        """(document_id, run_id, path, length, modified): each document's newest run, by name. Contents aren't read."""
        with _few_listers(self.spark):
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        at = lambda i: F.regexp_extract("path", self.layout, i)
        rows = listed.select(at(1).alias("document_id"), F.struct(at(2).alias("run_id"), "path", "length", F.col("modificationTime").alias("modified")).alias("f"))
        return rows.filter("document_id != ''").groupBy("document_id").agg(F.max("f").alias("f")).select("document_id", "f.*")

    def update(self, root: str, name: str = "graph.json", batch: int = 100_000) -> dict[str, int]:
        """Take in what is new or changed under ``root``, ``batch`` files at a time (the driver holds their paths); returns counts of files read and of those with errors."""
        found = settle(self.scan(root, name), "found")
        done = {"files": 0, "errors": 0}
        while True:
            new = found
            if self.files.exists():
                new = found.join(self.files.read().select("document_id", "path", "length", "modified"), ["document_id", "path", "length", "modified"], "left_anti")
            paths = [r["path"] for r in new.orderBy("document_id").limit(batch).select("path").collect()]  # bounded by ``batch``
            if not paths:
                self._finish()
                return done
            with _few_listers(self.spark):
                opened = self.spark.read.format("binaryFile").load(paths)
            read = opened.select("path", F.from_json(F.decode("content", "UTF-8"), GRAPH).alias("g"))
            read = settle(found.join(read, "path"), "read")
            empty = F.col("g").isNull() | (F.col("g.nodes").isNull() & F.col("g.links").isNull())
            files = read.select("document_id", "run_id", "path", "length", "modified", F.when(empty, "no graph").alias("error"))
            done["files"] += len(paths)
            done["errors"] += files.filter("error is not null").count()
            n = read.select("document_id", F.explode("g.nodes").alias("n")).select("document_id", F.col("n.id").alias("node_id"), "n.layer", "n.occurrence_count", "n.confidence")
            e = read.select("document_id", F.explode("g.links").alias("e")).select("document_id", F.col("e.source").alias("src"), "e.relation_type", F.col("e.target").alias("dst"), "e.occurrence_count", "e.confidence")
            whole = lambda df: df.withColumns({"occurrence_count": F.coalesce("occurrence_count", F.lit(1)), "confidence": F.coalesce("confidence", F.lit(0.0))})
            self._change(files, _summed(whole(n), ["document_id", *NODE], F.min("layer").alias("layer")), _summed(whole(e), ["document_id", *EDGE]))
            self.files.upsert(files)

    def remove(self, documents: DataFrame) -> None:
        """Documents (document_id) go, with what only they said. Files that are still there come back with the next update."""
        documents = settle(documents.select("document_id").distinct(), "gone")
        none = self.spark.createDataFrame([], "document_id string, node_id string, occurrence_count long, confidence double, layer int")
        no_edge = self.spark.createDataFrame([], "document_id string, src string, relation_type string, dst string, occurrence_count long, confidence double")
        self._change(documents, none, no_edge)
        self.files.delete(documents)

    def documents_of(self, nodes: DataFrame) -> DataFrame:
        """(node_id, document_id) for nodes (node_id)."""
        return self.parts["nodes"].read().join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "document_id")

    def _change(self, documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        fresh = {"nodes": (settle(nodes.filter("node_id is not null"), "nodes"), NODE), "edges": (settle(edges.dropna(subset=EDGE), "edges"), EDGE)}
        for kind, (rows, keys) in fresh.items():
            touched = rows.select(*keys)
            if self.parts[kind].exists():
                touched = touched.union(self.parts[kind].read().join(documents.select("document_id"), "document_id", "left_semi").select(*keys))
            touched.distinct().write.mode("append").parquet(f"{self.path}/pending/{kind}")
        for kind, (rows, _) in fresh.items():
            self.parts[kind].replace(documents, rows)
        self._finish()

    def _finish(self) -> None:
        """Bring the graph's nodes and edges that are written down as pending into agreement with their parts."""
        store = Files(self.spark, self.path)
        for kind, keys, table in (("nodes", NODE, self.graph.nodes), ("edges", EDGE, self.graph.edges)):
            if not store.exists(f"pending/{kind}/_SUCCESS") or not self.parts[kind].exists():
                continue
            touched = settle(self.spark.read.schema(", ".join(f"{k} string" for k in keys)).parquet(f"{self.path}/pending/{kind}").distinct(), "touched")
            held = self.parts[kind].read().join(touched, keys, "left_semi")
            least = [F.min("layer").alias("layer")] if kind == "nodes" else []
            merged = settle(_summed(held, keys, F.count("*").alias("corroboration"), *least), "merged")
            table.upsert(merged)
            table.delete(touched.join(merged, keys, "left_anti"))
        store.delete("pending")
