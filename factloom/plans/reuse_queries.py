"""Registered queries of variants of documents, lookups in earlier chunks, rebuilt graphs and the freshness of facts, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import communities, constellation, graph, lookup, models, reasoning, semantic
from factloom.plans import inputs as I
from factloom.plans.queries import query
from factloom.shared import folder, settle, spread, table
from factloom.sources import rebuild
from factloom.streaming import freshness

_PLAIN = "lower(trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '))"
_LINE = _PLAIN.format("line")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
a AS (SELECT DISTINCT doc_id, substr(sha256(chr(10) || trim(regexp_extract({_LINE}, '^[^.!?]*[.!?]*'), ' ') || chr(10) || trim(regexp_extract({_LINE}, '[^.!?]*[.!?]*$'), ' ')), 1, 16) AS x FROM l WHERE trim(line, ' ') != ''),
d AS (SELECT doc_id, list_sort(list(x)) AS s FROM a GROUP BY doc_id), c AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM d GROUP BY s), e AS (SELECT id, n, unnest(s) AS x FROM c)
SELECT p.id AS small_id, q.id AS large_id, count(*) AS shared, count(*) / p.n::DOUBLE AS share FROM e p JOIN e q ON p.x = q.x AND (p.n < q.n OR p.n = q.n AND p.id < q.id) GROUP BY p.id, q.id, p.n HAVING count(*) >= 0.7 * p.n""")
def document_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a document is a section without a title."""
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("content"))
    return constellation.variants(constellation.constellations(lines.withColumn("title", F.lit(""))))


@query("""WITH m AS (SELECT max(vec_id) + 1 AS m FROM embeddings), t AS (SELECT conv_id, turn, text, embedding::DOUBLE[] AS e, (7 * conv_id + 3 * turn) % 10 AS c FROM conversations JOIN embeddings ON vec_id = (31 * conv_id + turn) % (SELECT m FROM m)),
s AS (SELECT a.conv_id, a.turn, b.turn AS before, b.text, list_cosine_similarity(a.e, b.e) AS r FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.c < 7)
SELECT conv_id AS document_id, turn AS position, rank::INT AS rank, conv_id || '-' || before AS chunk_id, text[:500] AS content_excerpt, round(r, 6) AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r DESC, before) AS rank FROM s) WHERE rank <= 3""")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Turns are chunks; those with a confidence under 0.7 look into earlier turns of their conversation."""
    v = table(spark, d, "embeddings")
    m = v.agg(F.max("vec_id") + 1).first()[0]
    t = table(spark, d, "conversations").withColumn("vec_id", (31 * F.col("conv_id") + F.col("turn")) % m).join(v.select("vec_id", "embedding"), "vec_id")
    chunks = t.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), "embedding")
    first = chunks.withColumn("resolution_confidence", (7 * F.col("document_id") + 3 * F.col("position")) % 10 / 10)
    found = lookup.lookup_again(first, chunks).filter(F.size("found") > 0).select("document_id", "position", F.posexplode("found").alias("rank", "hit"))
    return found.select("document_id", "position", (F.col("rank") + 1).alias("rank"), "hit.*").withColumn("relevance_score", F.round("relevance_score", 6))


def _write_runs(files: DataFrame, at: str, each: int = 200) -> None:
    """A file each of files (document_id, run_id, value), about ``each`` a task: making a file costs far more than its bytes, by which Spark would merge tasks.

    Tasks make them by pyarrow's file systems: Hadoop's local one starts a process for the permissions of each file, checksum and folder, and Spark's writer makes
    each of them in a folder of its own first. Where pyarrow doesn't know the store Spark writes. A repeated task makes the same files again.
    """
    files = settle(files, "files")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // each))
    dealt = files.select("document_id", "run_id", "value").repartition(tasks, "document_id", "run_id")
    try:
        pa.fs.FileSystem.from_uri(at)
    except (pa.ArrowException, OSError):  # a scheme it doesn't know, a library it lacks
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("document_id", "run_id").text(at)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(at)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for document, run, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where = f"{root}/document_id={document}/run_id={run}"
                fs.create_dir(where, recursive=True)
                with fs.open_output_stream(f"{where}/part-{part:05d}-{n}.txt", compression=None) as f:
                    f.write(value.encode() + b"\n")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    dealt.mapInArrow(write, "files long").agg(F.sum("files")).first()


_MENTIONS = "SELECT seq // 80 AS doc, subject AS node_id, confidence FROM raw UNION ALL SELECT seq // 80, object, confidence FROM raw"


@query(f"""WITH {I.RAW}, m AS ({_MENTIONS})
SELECT 'node' AS kind, node_id AS src, '' AS relation_type, '' AS dst, count(*) AS occurrence_count, max(confidence) AS confidence, count(DISTINCT doc) AS corroboration FROM m GROUP BY node_id
UNION ALL SELECT 'edge', subject, predicate, object, count(*), max(confidence), count(DISTINCT seq // 80) FROM raw GROUP BY subject, predicate, object""")
def graph_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Twenty customers are a document. Each has a file of an older run with other counts, and a newer one; the graph is rebuilt from the files, twice."""
    facts = settle(I.raw_facts(spark, d).withColumn("document_id", F.floor(F.col("seq") / 80).cast("string")), "facts")
    ends = facts.select("document_id", "confidence", F.explode(F.array("subject", "object")).alias("id"))
    n = ends.groupBy("document_id", "id").agg(F.count("*").alias("occurrence_count"), F.max("confidence").alias("confidence"))
    e = facts.groupBy("document_id", F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("relation_type")).agg(F.count("*").alias("occurrence_count"), F.max("confidence").alias("confidence"))
    listed = lambda df, name: df.groupBy("document_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "document_id"])).alias(name))  # noqa: E731 - twenty customers
    newer = listed(n, "nodes").join(listed(e, "links"), "document_id").select("document_id", F.lit("r2").alias("run_id"), F.to_json(F.struct("nodes", "links")).alias("value"))
    older = listed(n.withColumn("occurrence_count", F.lit(1000)), "nodes").select("document_id", F.lit("r1").alias("run_id"), F.to_json(F.struct("nodes")).alias("value"))
    at = folder(spark, "runs")
    _write_runs(newer.union(older), at)
    built = rebuild.Rebuild(spark, folder(spark, "rebuilt"), layout=r"document_id=([^/]+)/run_id=([^/]+)/")
    built.update(at, "*.txt")
    built.update(at, "*.txt")
    count = ["occurrence_count", "confidence", "corroboration"]
    nodes = built.graph.nodes.read().select(F.lit("node").alias("kind"), F.col("node_id").alias("src"), F.lit("").alias("relation_type"), F.lit("").alias("dst"), *count)
    return nodes.union(built.graph.edges.read().select(F.lit("edge"), "src", "relation_type", "dst", *count))


_STALE, _GONE = freshness.spans(1.0)


@query(f"""WITH c AS (SELECT DISTINCT user_id || '-' || event_type AS fact_id, 'd' || (event_id * event_id % 11 // 9) AS document_id, epoch_us(ts) AS t FROM events),
n AS (SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS a FROM c WINDOW w AS (PARTITION BY fact_id ORDER BY t, document_id)),
l AS (SELECT *, sum(CASE WHEN t - b > {_GONE} THEN 1 ELSE 0 END) OVER (PARTITION BY fact_id ORDER BY t, document_id) AS life FROM n),
o AS (SELECT *, first_value(document_id) OVER (PARTITION BY fact_id, life ORDER BY t, document_id) AS own FROM l),
s AS (SELECT *, coalesce(min(t) FILTER (WHERE document_id != own) OVER (PARTITION BY fact_id), 9223372036854775807) AS shared FROM o)
SELECT fact_id, 'fresh' AS status, make_timestamp(t) AS at FROM s WHERE b IS NULL OR b < shared AND t - b > {_STALE}
UNION ALL SELECT fact_id, 'stale', make_timestamp(t + {_STALE}) FROM s WHERE t < shared AND (a IS NULL OR a > t + {_STALE})
UNION ALL SELECT fact_id, 'deleted', make_timestamp(t + {_GONE}) FROM s WHERE t < shared AND (a IS NULL OR a > t + {_GONE})""")
def fact_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Events confirm facts; with a half-life of one day, for the events of a user lie close together."""
    e = table(spark, d, "events")
    doc = F.concat(F.lit("d"), F.floor(F.col("event_id") * F.col("event_id") % 11 / 9).cast("string"))
    return freshness.transitions(e.select(F.concat_ws("-", "user_id", "event_type").alias("fact_id"), doc.alias("document_id"), F.col("ts").alias("at")), half_life=1.0).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query()
def semantic_variants(spark: SparkSession, d: str) -> DataFrame:
    """Lines are chunks, embedded by their words; no SQL, as cells are made by hyperplanes. Tested against exact similarity."""
    lines = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("line"))
    return semantic.near_documents(settle(lines.select("document_id", models.embed(F.col("line"), model=models.embed_words).alias("embedding")).filter("embedding is not null"), "chunks"))


_SAYS = ("requires", "does_not_require", "Never requires", "require", "cannot wait for", "can wait for", "has", "doesn't have")
_SAYS_SQL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in ("require", "require", "require", "require", "can wait for", "can wait for", "have", "have")) + "]"


@query(f"""WITH f AS (SELECT 'c' || o_custkey AS subject, lower(o_orderpriority) AS object, {_SAYS_SQL}[o_orderkey % 8 + 1] AS predicate, o_orderkey % 8 IN (1, 2, 4, 7) AS no, o_orderkey AS q FROM orders)
SELECT subject, object, predicate, count(*) FILTER (WHERE NOT no) AS affirmed, count(*) FILTER (WHERE no) AS denied, min(q) FILTER (WHERE NOT no) AS first_affirmed, min(q) FILTER (WHERE no) AS first_denied FROM f GROUP BY ALL HAVING bool_or(no) AND bool_or(NOT no)""")
def negation_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Each order states or denies a relation of its customer to its priority."""
    says = F.array(*map(F.lit, _SAYS))[(F.col("o_orderkey") % 8).cast("int")]
    return reasoning.negations(table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), says.alias("predicate"), F.col("o_orderkey").alias("seq")))


@query(f"""WITH f AS (SELECT 'C' || o_custkey AS src, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE (o_orderkey % 100)::VARCHAR END AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'measured_at' ELSE 'has_attribute' END AS relation_type, (o_orderkey % 10) / 10.0::DOUBLE AS c FROM orders)
SELECT src, dst, relation_type, count(*) AS occurrence_count, max(c) AS confidence FROM f WHERE ({I.LITERAL("dst")}) AND NOT ({I.LITERAL("src")}) GROUP BY ALL""")
def attribute_edges(spark: SparkSession, d: str) -> DataFrame:
    """An order gives its customer a number, every fifth a status; a third of them have a date, another third a blank one."""
    k = F.col("o_orderkey")
    scope = F.when(k % 3 == 0, F.col("o_orderdate").cast("string")).when(k % 3 == 1, " ")
    o = F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise((k % 100).cast("string"))
    return graph.attribute_edges(table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("subject"), o.alias("object"), scope.alias("temporal_scope"), (k % 10 / 10).alias("confidence")))


@query("""WITH t AS (SELECT DISTINCT 'C' || o_custkey AS src, o_orderkey // 8 AS x FROM orders), s AS (SELECT src, count(*) AS n FROM t GROUP BY src),
n AS (SELECT o_orderpriority AS dst, o_orderkey // 8 AS x FROM orders UNION SELECT o_orderstatus, o_orderkey // 8 FROM orders)
SELECT src, dst, 'encompasses' AS relation_type, count(*) / n::DOUBLE AS confidence FROM t JOIN n USING (x) JOIN s USING (src) GROUP BY src, dst, n HAVING 2 * count(*) >= n""")
def topic_encompasses(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders are a topic, blocks of eight order numbers chunks, priorities and states nodes."""
    o = table(spark, d, "orders").withColumn("chunk", F.expr("o_orderkey div 8"))
    topics = o.select(F.concat(F.lit("C"), "o_custkey").alias("src"), "chunk")
    return communities.encompassed(topics, o.select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("dst"), "chunk"))
