"""Stores as Parquet tables: vectors, graph, cache, runs. Upserts write what they change beside the old version."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators.retrieval import top_k
from factloom.operators.vectors import Lists, fit, meet_lists, placed
from factloom.shared import settle


class Files:
    """Text files, listing and a 'latest' marker on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    def write(self, name: str, text: str) -> None:
        out = self._fs().create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        data = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return data

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._at(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str) -> bool:
        return self._fs().delete(self._at(name), True)

    def copy(self, source: str, target: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(), self._at(source), self._fs(), self._at(target), False, self._conf)

    def point(self, name: str, target: str) -> None:
        """A link by content: stores without links keep a small redirect file."""
        self.write(name, json.dumps({"redirect": target}))

    def follow(self, name: str) -> str:
        return json.loads(self.read(name))["redirect"]


class Table:
    """A keyed table in buckets by key; readers see the last complete version.

    A version is a small list of which folder holds which bucket, so an upsert or delete rewrites only the buckets that
    its keys fall into. Folders of older versions stay for their readers until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 32):
        self.spark, self.files, self.keys, self.buckets = spark, Files(spark, path), keys, buckets

    def exists(self) -> bool:
        return self.files.exists("latest")

    def _version(self, name: str | None = None) -> dict:
        return json.loads(self.files.read(f"{name or self.files.follow('latest')}.json")) if name or self.exists() else {"n": -1, "buckets": {}, "schema": None}

    def _read(self, version: dict, buckets: list[int] | None = None) -> DataFrame:
        held = [f"{self.files.root}/{folder}" for b, folder in version["buckets"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(version["schema"]))
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self._version())

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _put(self, version: dict, df: DataFrame, touched: list[int]) -> None:
        """df: all rows of the touched buckets."""
        n = version["n"] + 1
        folder = f"v{n:06d}"
        df.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.files.root}/{folder}")
        full = {int(x.split("=")[1]) for x in self.files.list(folder) if x.startswith("_bucket=")}
        kept = {b: f for b, f in version["buckets"].items() if int(b) not in touched}
        new = {"n": n, "schema": df.schema.json(), "buckets": kept | {str(b): f"{folder}/_bucket={b}" for b in sorted(full)}}
        self.files.write(f"{folder}.json", json.dumps(new))
        self.files.point("latest", folder)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets`` numbers

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of equal keys; of rows with an equal key in one call one stays. Columns that one side lacks are null."""
        rows = settle(rows.dropDuplicates(self.keys), "rows")
        version = self._version()
        touched = self._touched(rows)
        if not touched and version["n"] >= 0:
            return
        if version["n"] >= 0:
            old = self._read(version, touched)
            rows = old.join(rows.select(self.keys), self.keys, "left_anti").unionByName(rows, allowMissingColumns=True)
        self._put(version, rows, touched)

    def delete(self, keys: DataFrame) -> None:
        """Rows of the given keys go; with some of the key columns only, all rows that agree in those."""
        if not self.exists():
            return
        on = [c for c in self.keys if c in keys.columns]
        version = self._version()
        touched = self._touched(keys) if len(on) == len(self.keys) else [int(b) for b in version["buckets"]]
        old = self._read(version, touched)
        if touched:
            self._put(version, old.join(keys.select(on), on, "left_anti"), touched)

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions uses; returns how many."""
        listed = self.files.list()
        versions = sorted(n[:-5] for n in listed if n.endswith(".json"))
        used = {f.split("/")[0] for v in versions[-max(keep, 1) :] for f in self._version(v)["buckets"].values()}
        gone = [n for n in listed if n.startswith("v") and not n.endswith(".json") and n not in used]
        for n in gone:
            self.files.delete(n)
        for v in versions[: -max(keep, 1)]:
            self.files.delete(f"{v}.json")
        return len(gone)

    def count(self) -> int:
        return self.read().count() if self.exists() else 0


class VectorStore:
    """Collections of (id, embedding, document, metadata map). A collection that is indexed keeps its index through every change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = Table(spark, path, ["collection", "id"])

    def index(self, collection: str, k: int = 10, recall: float = 0.95, lists: int | None = None) -> VectorIndex:
        """Index a collection from now on; again, to fit it anew to what the collection has become."""
        rows = self.table.read().filter(F.col("collection") == collection)
        return VectorIndex.build(self.spark, f"{self.path}-index-{collection}", rows.select("id", "embedding", "metadata"), k, recall, lists)

    def _index(self, collection: str) -> VectorIndex | None:
        return VectorIndex.open(self.spark, f"{self.path}-index-{collection}")

    def upsert(self, collection: str, rows: DataFrame) -> None:
        rows = settle(rows.dropDuplicates(["id"]), "rows")
        self.table.upsert(rows.withColumn("collection", F.lit(collection)))
        if index := self._index(collection):
            index.upsert(rows.select("id", "embedding", "metadata"))

    def query(self, collection: str, queries: DataFrame, k: int, where: dict | None = None, exact: bool = False) -> DataFrame:
        """The k nearest rows of each query: by the collection's index if it has one, else, or if ``exact``, among all."""
        kept = None
        for key, value in (where or {}).items():
            is_it = F.col("metadata")[key] == str(value)
            kept = is_it if kept is None else kept & is_it
        if not exact and (index := self._index(collection)):
            return index.query(queries, k, kept)
        rows = self.table.read().filter(F.col("collection") == collection)
        return top_k(queries, rows if kept is None else rows.filter(kept), k)

    def delete(self, collection: str, ids: DataFrame) -> None:
        self.table.delete(ids.withColumn("collection", F.lit(collection)))
        if index := self._index(collection):
            index.delete(ids)

    def count(self, collection: str) -> int:
        return self.table.read().filter(F.col("collection") == collection).count() if self.table.exists() else 0


class _Lists(Table):
    """A table with a folder for each list."""

    def _bucket(self):
        return F.col("list").cast("int")


class VectorIndex:
    """Inverted lists on files: each list of vectors is a folder of its own, and a search opens only those that it looks into.

    Centres and the number of lists to look into are fitted once (``vectors.fit``) and stay; later rows go to their nearest centre's list.
    A row that moves or goes is found by a second table (id, list), so a change rewrites the lists that it concerns and no other. Readers see the
    last complete version of the lists.
    """

    def __init__(self, spark: SparkSession, path: str, lists: Lists):
        self.spark, self.path, self.lists = spark, path, lists
        self.rows, self.places = _Lists(spark, f"{path}/lists", ["list", "id"]), Table(spark, f"{path}/places", ["id"])

    @classmethod
    def build(cls, spark: SparkSession, path: str, rows: DataFrame, k: int = 10, recall: float = 0.95, lists: int | None = None) -> VectorIndex:
        """An index of rows (id, embedding and what filters need), in place of one that was there."""
        fitted = fit(rows, k, recall, lists)
        if fitted is None:
            raise ValueError("an index needs vectors to be fitted on")
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.centres)], "list int, centre array<double>")  # 4096 at most
        files = Files(spark, path)
        for name in ("lists", "places"):
            files.delete(name)
        centres.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        files.write("probes.json", json.dumps({"probes": fitted.probes, "recall": fitted.recall}))
        out = cls(spark, path, fitted)
        out.upsert(rows)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex | None:
        files = Files(spark, path)
        if not files.exists("probes.json"):
            return None
        known = json.loads(files.read("probes.json"))
        centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()]  # 4096 at most
        return cls(spark, path, Lists(np.array(centres, float), known["probes"], known["recall"]))

    def _change(self, ids: DataFrame, fresh: DataFrame | None) -> None:
        """Rows of ``ids`` leave their lists; ``fresh`` (with list) come in."""
        version = self.rows._version()
        left = self.places.read().join(ids.select("id"), "id", "left_semi").select("list").distinct() if self.places.exists() else None
        touched = {r[0] for r in left.collect()} if left is not None else set()  # numbers of lists, 4096 at most
        if fresh is not None:
            touched |= {r[0] for r in fresh.select(F.col("list").cast("int")).distinct().collect()}
        if not touched:
            return
        kept = self.rows._read(version, sorted(touched)).join(ids.select("id"), "id", "left_anti") if version["n"] >= 0 else None
        rows = fresh if kept is None else kept if fresh is None else kept.unionByName(fresh, allowMissingColumns=True)
        self.rows._put(version, rows, sorted(touched))

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of equal ids; of rows with an equal id in one call one stays. Rows without an embedding go."""
        rows = settle(rows.filter("id is not null").dropDuplicates(["id"]), "rows")
        kept = settle(placed(rows.filter("embedding is not null"), self.lists, 1), "placed")
        self._change(rows, kept)
        self.places.delete(rows.filter("embedding is null").select("id"))
        self.places.upsert(kept.select("id", F.col("list").cast("int").alias("list")))

    def delete(self, ids: DataFrame) -> None:
        ids = settle(ids.select("id").distinct(), "ids")
        self._change(ids, None)
        self.places.delete(ids)

    def looked_into(self, queries: DataFrame) -> DataFrame:
        """All rows of the lists that these queries (query_id, embedding, list) look into, read from those lists' folders alone."""
        asked = [r[0] for r in queries.select(F.col("list").cast("int")).distinct().collect()]  # 4096 at most
        return self.rows._read(self.rows._version(), asked)

    def query(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, embedding): the k nearest rows that ``where`` keeps, in the lists looked into."""
        q = settle(placed(queries.select("query_id", "embedding"), self.lists, self.lists.probes), "asked")
        rows = self.looked_into(q)
        rows = rows if where is None else rows.filter(where)
        return meet_lists(q, rows.select("id", "embedding", F.col("list").cast("long").alias("list")), k)

    def measured_recall(self, queries: DataFrame, k: int = 10) -> float:
        """Share of the true k nearest rows of these queries that ``query`` finds, by an exact search over all rows."""
        true = top_k(queries, self.rows.read(), k).select("query_id", "id")
        found = self.query(queries, k).select("query_id", "id")
        n = true.count()
        return true.join(found, ["query_id", "id"], "left_semi").count() / n if n else 1.0

    def vacuum(self, keep: int = 1) -> int:
        return self.rows.vacuum(keep) + self.places.vacuum(keep)


class GraphStore:
    """Nodes and edges; deleting a node deletes its edges."""

    def __init__(self, spark: SparkSession, path: str):
        self.nodes = Table(spark, f"{path}/nodes", ["node_id"])
        self.edges = Table(spark, f"{path}/edges", ["src", "relation_type", "dst"])

    def import_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes.upsert(nodes)
        self.edges.upsert(edges)

    def node(self, node: str) -> DataFrame:
        return self.nodes.read().filter(F.col("node_id") == node)

    def counts(self) -> dict[str, int]:
        """Nodes, edges and different source documents, where nodes name them."""
        nodes = self.nodes.read() if self.nodes.exists() else None
        documents = nodes.select(F.explode("source_documents")).distinct().count() if nodes is not None and "source_documents" in nodes.columns else 0
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "documents": documents}

    def edges_of(self, node: str, direction: str = "both", relation: str | None = None) -> DataFrame:
        e = self.edges.read()
        side = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
        return e.filter(side & (F.col("relation_type") == relation if relation else F.lit(True)))

    def delete_node(self, node: str) -> None:
        spark = self.nodes.spark
        self.nodes.delete(spark.createDataFrame([(node,)], "node_id string"))
        for end in ("src", "dst"):
            self.edges.delete(spark.createDataFrame([(node,)], f"{end} string"))


class Runs:
    """Run folders with a manifest, step folders and a latest pointer."""

    STEPS = ("00_metadata", "01_extraction", "02_chunks", "03_analysis", "04_synthesis")

    def __init__(self, spark: SparkSession, root: str, document_id: str):
        self.files = Files(spark, f"{root}/{document_id}")
        self.spark = spark

    def create(self, run_id: str, carried_from: str | None = None) -> dict:
        m = {"run_id": run_id, "status": "running", "carried_from": carried_from, "steps": {}}
        self._save(m)
        return m

    def _save(self, m: dict) -> None:
        self.files.write(f"runs/{m['run_id']}/manifest.json", json.dumps(m))

    def manifest(self, run_id: str) -> dict:
        return json.loads(self.files.read(f"runs/{run_id}/manifest.json"))

    def step_path(self, run_id: str, step: str) -> str:
        return f"{self.files.root}/runs/{run_id}/{step}"

    def complete_step(self, run_id: str, step: str, output: DataFrame | None = None, digest: str | None = None) -> None:
        if output is not None:
            output.write.mode("overwrite").parquet(self.step_path(run_id, step))
        m = self.manifest(run_id)
        m["steps"][step] = {"status": "done", "digest": digest}
        self._save(m)

    def read_step(self, run_id: str, step: str) -> DataFrame:
        """A step's output, from the run it was carried from where this one has none."""
        m = self.manifest(run_id)
        if step not in m["steps"] and m["carried_from"]:
            return self.read_step(m["carried_from"], step)
        return self.spark.read.parquet(self.step_path(run_id, step))

    def write_text(self, run_id: str, name: str, text: str) -> None:
        """A text of the run (enriched_text, dense_summary ...)."""
        self.files.write(f"runs/{run_id}/{name}", text)

    def read_text(self, run_id: str, name: str) -> str | None:
        at = f"runs/{run_id}/{name}"
        return self.files.read(at) if self.files.exists(at) else None

    def write_chunk_index(self, run_id: str, names: list[str]) -> None:
        self.files.write(f"runs/{run_id}/chunk_index.json", json.dumps(names))

    def read_chunks(self, run_id: str, step: str = "02_chunks", id_col: str = "id") -> DataFrame:
        """The run's chunks with ``ord``: their place in the chunk index, else their order by name; those the index doesn't list come last."""
        chunks = self.read_step(run_id, step)
        listed = json.loads(self.read_text(run_id, "chunk_index.json") or "[]")
        index = self.spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(listed))], f"{id_col} string, _at long")
        ord_ = F.row_number().over(Window.orderBy(F.col("_at").asc_nulls_last(), id_col)) - 1  # the chunks of one document
        return chunks.join(F.broadcast(index), id_col, "left").withColumn("ord", ord_).drop("_at")

    def finalize(self, run_id: str) -> None:
        m = self.manifest(run_id)
        m["status"] = "done"
        self._save(m)
        self.files.point("runs/latest.json", run_id)

    def latest(self) -> str | None:
        if self.files.exists("runs/latest.json"):
            return self.files.follow("runs/latest.json")
        names = [n for n in self.files.list("runs") if not n.endswith(".json")]
        return max(names, default=None)


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(step, change): steps (step, digest) of two runs by full outer join."""
    j = a.select("step", F.col("digest").alias("da")).join(b.select("step", F.col("digest").alias("db")), "step", "full")
    change = F.when(F.col("da").isNull(), "added").when(F.col("db").isNull(), "removed").when(F.col("da") == F.col("db"), "same").otherwise("changed")
    return j.select("step", change.alias("change"))


def export_csv(calls: DataFrame, path: str, columns: list[str]) -> None:
    have = [F.col(c) if c in calls.columns else F.lit(None).cast("string").alias(c) for c in columns]
    calls.select(*have).write.mode("overwrite").option("header", True).csv(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str) -> None:
    """Node-link JSON, GraphML, GEXF or Cypher statements as text.

    Written in parts by all tasks; the parts one after the other are the file, which ``joined`` makes of them.
    """
    from factloom.functions.text import cypher_text

    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n, s, t, r = F.col("node_id"), F.col("src"), F.col("dst"), F.col("relation_type")
    if kind == "json":
        a = nodes.select(F.to_json(F.struct(F.col("node_id").alias("id"), *[c for c in nodes.columns if c != "node_id"])).alias("value"))
        b = edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])).alias("value"))
        heads = ['{"directed": true, "multigraph": true, "nodes": [', '], "links": [', "]}"]
        _ordered(nodes.sparkSession, path, [heads[0], _listed(a), heads[1], _listed(b), heads[2]])
        return
    if kind == "cypher":
        a = nodes.select(F.concat(F.lit('MERGE (:Entity {name: "'), cypher_text(n), F.lit('"});')).alias("value"))
        b = edges.select(F.concat(F.lit('MATCH (a:Entity {name: "'), cypher_text(s), F.lit('"}), (b:Entity {name: "'), cypher_text(t), F.lit('"}) MERGE (a)-[:'), F.upper(F.regexp_replace(r, "[^A-Za-z0-9_]", "_")), F.lit("]->(b);")))
        _ordered(nodes.sparkSession, path, [a, b])
        return
    heads = {
        "graphml": ('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="rel" for="edge" attr.name="relation_type" attr.type="string"/><graph edgedefault="directed">', "</graph></graphml>"),
        "gexf": ('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><nodes>', "</edges></graph></gexf>"),
    }
    if kind not in heads:
        raise ValueError(f"no export named {kind}")
    if kind == "graphml":
        a = nodes.select(F.concat(F.lit('<node id="'), esc(n), F.lit('"/>')).alias("value"))
        b = edges.select(F.concat(F.lit('<edge source="'), esc(s), F.lit('" target="'), esc(t), F.lit('"><data key="rel">'), esc(r), F.lit("</data></edge>")).alias("value"))
        middle = ""
    else:
        a = nodes.select(F.concat(F.lit('<node id="'), esc(n), F.lit('" label="'), esc(n), F.lit('"/>')).alias("value"))
        b = edges.select(F.concat(F.lit('<edge source="'), esc(s), F.lit('" target="'), esc(t), F.lit('" label="'), esc(r), F.lit('"/>')).alias("value"))
        middle = "</nodes><edges>"
    _ordered(nodes.sparkSession, path, [heads[kind][0], a, middle, b, heads[kind][1]])


def _listed(rows: DataFrame) -> DataFrame:
    """JSON values, a comma before all but the least."""
    least = rows.agg(F.min("value").alias("_first"))
    # rows that are equal stand side by side, so only the first of them goes without
    marked = rows.groupBy("value").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(least))  # one row
    each = marked.select("value", "_first", F.posexplode(F.sequence(F.lit(1), F.col("_n"))).alias("_i", "_k"))
    return each.select(F.when((F.col("value") == F.col("_first")) & (F.col("_i") == 0), F.concat(F.lit(" "), "value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))


def _ordered(spark: SparkSession, path: str, parts: list) -> None:
    """Texts and frames (value) one after the other, sorted inside each, dealt in ranges to all tasks."""
    rows = None
    for i, part in enumerate(parts):
        df = part.toDF("value").select(F.lit(i).alias("o"), "value") if isinstance(part, DataFrame) else spark.createDataFrame([(i, part)] if part else [], "o int, value string")
        rows = df if rows is None else rows.unionByName(df)
    rows.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def joined(spark: SparkSession, path: str, target: str) -> None:
    """The parts of a text written in order as one file, streamed from store to store."""
    folder, out = Files(spark, path), Files(spark, target.rpartition("/")[0])
    stream = out._fs().create(out._at(target.rpartition("/")[2]), True)
    try:
        for name in folder.list():
            if name.startswith("part-"):
                source = folder._fs().open(folder._at(name))
                try:
                    spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
                finally:
                    source.close()
    finally:
        stream.close()
