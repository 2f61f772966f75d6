"""Registered queries of answers, counters, identifiers, stores' entries and the corpus level, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import answers, chunking, dedup, entities, facts, graph, models, reasoning, references, retrieval, tracking, vectors
from factloom.plans import inputs as I
from factloom.plans.queries import query
from factloom.shared import spread, table
from factloom.sources import indexer, reports

_J = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""SELECT c_custkey, s AS seq, CASE s WHEN 0 THEN 'citation' ELSE 'internal_ref' END AS type, CASE s WHEN 0 THEN c_name ELSE 'see ' || c_mktsegment END AS text, CASE s WHEN 0 THEN NULL ELSE c_mktsegment END AS target, CASE s WHEN 0 THEN 'document' ELSE 'c1' END AS source_chunk_id
FROM customer, (VALUES (0), (3)) r(s) WHERE c_custkey % 7 != 0""")
def parse_references(spark: SparkSession, d: str) -> DataFrame:
    body = _J('{"references": [{"type": "citation", "text": "', F.col("c_name"), '"}, {"type": "unknown", "text": "x"}, {"type": "footnote"}, {"type": "internal_ref", "text": "see ', F.col("c_mktsegment"), '", "target": "', F.col("c_mktsegment"), '", "source_chunk_id": "c1"}], "confidence": 0.7}')
    c = spread(table(spark, d, "customer")).select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "none").when(F.col("c_custkey") % 2 == 0, _J("```json\n", body, "\n```")).otherwise(body).alias("answer"))
    return answers.parse_references(c)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS overall_quality, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 2 END::INT AS issue_count, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END::INT AS high_severity_count, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS summary FROM supplier")
def parse_issues(spark: SparkSession, d: str) -> DataFrame:
    body = _J('{"overall_quality": 0.25, "issues": [{"severity": "high", "category": "gap"}, {"description": "', F.col("s_name"), '"}], "summary": "', F.col("s_name"), '"}')
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "[]").otherwise(body).alias("answer"))
    return answers.parse_issues(s).drop("issues")


@query("""WITH a AS (SELECT *, conv_id % 3 = 0 AS bad FROM conversations)
SELECT conv_id, turn, CASE WHEN bad THEN text ELSE 'He: ' || role END AS content, text AS original_content, CASE WHEN bad THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN bad THEN substr(text, 1, 500) ELSE 'sum ' || turn END AS updated_summary,
  CASE WHEN trim(CASE WHEN bad THEN text ELSE 'He: ' || role END) = '' THEN 0.0 WHEN bad THEN 0.0 ELSE 0.5 END::DOUBLE AS content_score FROM a""")
def parse_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Decontextualised and summarised chunks, applied, with the agent's own score."""
    bad = F.col("conv_id") % 3 == 0
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"), F.lit("").alias("current_summary"), F.when(bad, "?").otherwise(_J('{"decontextualized_content": "He: ', F.col("role"), '"}')).alias("answer"), F.when(bad, "?").otherwise(_J('{"updated_summary": "sum ', F.col("turn").cast("string"), '"}')).alias("second"))
    summed = answers.parse_summaries(c, "second").drop("confidence", "new_information")
    out = answers.apply_decontextualization(answers.parse_decontextualized(summed))
    return out.withColumn("content_score", answers.content_score(F.col("content"), F.col("confidence"))).select("conv_id", "turn", "content", "original_content", "confidence", "updated_summary", "content_score")


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, (doc_id % 10) / 10.0::DOUBLE AS c, [(doc_id % 7) / 10.0::DOUBLE, (doc_id % 5) / 10.0::DOUBLE] AS d FROM documents)
SELECT doc_id, round(least((d[1] + d[2]) / 2, c), 6) AS facts, CASE WHEN trim(t) = '' THEN 0 WHEN length(t) < 50 THEN least(c, 0.5) ELSE c END::DOUBLE AS summary,
  round(CASE WHEN trim(t) = '' THEN 0 WHEN d[2] > d[1] THEN least(c + 0.1, 1.0) ELSE c END::DOUBLE, 6) AS density, round(CASE WHEN trim(t) = '' THEN 0 ELSE least(c * least(length(t) / 500.0::DOUBLE, 1.0), 1.0) END::DOUBLE, 6) AS synthesis FROM x""")
def self_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    c, scores = (k % 10) / 10, F.array((k % 7) / 10, (k % 5) / 10)
    return spread(table(spark, d, "documents")).select(
        "doc_id", F.round(answers.facts_score(scores, c), 6).alias("facts"), answers.summary_score(F.col("text"), c).alias("summary"),
        F.round(answers.density_score(F.col("text"), scores, c), 6).alias("density"), F.round(answers.synthesis_score(F.col("text"), c), 6).alias("synthesis"),
    )


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate AS t FROM orders)
SELECT o_orderkey, strftime(t, '%Y%m%d_%H%M%S') || '_' || substr(md5(o_orderkey::VARCHAR), 1, 8) AS document_id,
  strftime(t, '%Y%m%d_%H%M') || '_' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc_' || o_custkey || '_' || strftime(t, '%Y%m%d_%H%M'))), 1, 12) AS run_id FROM x""")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", X.document_id(at, F.col("o_orderkey")).alias("document_id"), X.run_id(_J("doc_", F.col("o_custkey").cast("string")), at).alias("run_id"))


@query(f"""WITH {I.CALLS}, n AS (SELECT count(*) AS found, count(*) FILTER (WHERE doc_id % 2 = 0) AS known, count(*) FILTER (WHERE doc_id % 2 = 1 AND doc_id % 5 = 0) AS bad FROM documents)
SELECT found AS files_found, found - known - bad AS processed, known AS skipped, bad AS errors, (SELECT count(*) FROM calls) AS calls, (SELECT sum(input_tokens + output_tokens)::BIGINT FROM calls) AS tokens FROM n""")
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a batch and of its calls."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    entries = docs.withColumn("cache_status", F.when(F.col("document_id") % 2 == 0, "exact").otherwise("new"))
    counted = tracking.batch_counts(entries, docs.filter("document_id % 5 = 0"))
    used = I.calls(spark, d).agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return counted.crossJoin(F.broadcast(used))  # one row each


@query("""WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-08-02 00:00:00') AS decayed,
  count(*) FILTER (WHERE round(greatest(0.05, (0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE) * greatest(0.05, pow(2.0, -greatest(0.0, (epoch_us(TIMESTAMP '1998-08-02 00:00:00') - epoch_us(o_orderdate)) / 86400e6) / 365.0))), 6) < 0.2) AS pruned FROM orders)
SELECT n AS total, decayed, 0::BIGINT AS undated, pruned FROM f""")
def decay_counters(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.lit(0.5) + (F.col("o_orderkey") % 50) / 100).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("last_updated_at"))
    return tracking.decay_counts(reasoning.decay(o, F.to_timestamp(F.lit("1998-08-02 00:00:00"))), 0.2)


@query(f"WITH {I.NODES} SELECT node_id AS name, 'concept' AS type, occurrence_count AS mentions, confidence FROM nodes WHERE NOT is_literal")
def concept_view(spark: SparkSession, d: str) -> DataFrame:
    return indexer.concepts(graph.build_nodes(facts.consolidate(I.raw_facts(spark, d)))).drop("aliases")


@query(f"WITH {I.CONS} SELECT subject AS source, predicate AS relation, object AS target, confidence, occurrence_count AS occurrences FROM cons")
def relation_view(spark: SparkSession, d: str) -> DataFrame:
    return indexer.relations(facts.consolidate(I.raw_facts(spark, d)))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN text || ' from ' || source ELSE text END AS document, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS section_title FROM documents WHERE coalesce(text, '') != ''")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as a vector store takes them: text and present metadata."""
    k = F.col("doc_id")
    rows = spread(table(spark, d, "documents")).filter("coalesce(text, '') != ''").select(k.cast("string").alias("chunk_id"), F.col("text").alias("content"), F.when(k % 2 == 0, _J("from ", F.col("source"))).alias("context_summary"), k.cast("string").alias("document_id"), F.when(k % 3 != 0, F.col("lang")).alias("section_title"))
    m = F.col("metadata")
    return indexer.entries(rows, "chunks").select("id", "document", m["document_id"].alias("document_id"), m["section_title"].alias("section_title"))


@query(f"""WITH {I.EDGES}, told AS (SELECT src AS node_id, src || ' → ' || relation_type || ' → ' || dst AS t FROM edges UNION ALL SELECT dst, src || ' → ' || relation_type || ' → ' || dst FROM edges),
g AS (SELECT node_id, list_sort(list(t)) AS r FROM told GROUP BY node_id HAVING count(*) >= 2)
SELECT node_id, 'unknown' AS entity_type, '(none)' AS aliases, array_to_string(list_transform(r[1:15], lambda x: '- ' || x), chr(10)) AS relations, len(r)::INT AS n_relations FROM g""")
def profile_contexts(spark: SparkSession, d: str) -> DataFrame:
    cons = facts.consolidate(I.raw_facts(spark, d))
    none = graph.build_nodes(cons).select("node_id", F.lit(None).cast("string").alias("entity_type"), F.array().cast("array<string>").alias("aliases"))
    return answers.profile_context(graph.build_edges(cons), none)


@query("""WITH m AS (SELECT 'group_' || n_regionkey AS component, n_name AS node, n_nationkey AS k FROM nation),
e AS (SELECT a.component, a.node || ' → near → ' || b.node AS t FROM m a JOIN m b ON a.component = b.component AND b.k = a.k + 1),
ms AS (SELECT component, list_sort(list(node || CASE WHEN k % 2 = 0 THEN ' (place)' ELSE ' (unknown)' END)) AS ms FROM m GROUP BY component),
es AS (SELECT component, list_sort(list(t)) AS es FROM e GROUP BY component)
SELECT component, CASE WHEN es IS NULL THEN '(none detected)' ELSE 'Members (' || len(ms) || '):' || chr(10) || array_to_string(list_transform(ms[1:20], lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || 'Intra-community relations (' || least(len(es), 15) || '):' || chr(10) || array_to_string(list_transform(es[1:15], lambda x: '- ' || x), chr(10)) END AS context FROM ms LEFT JOIN es USING (component)""")
def group_contexts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    members = n.select(_J("group_", F.col("n_regionkey").cast("string")).alias("component"), F.col("n_name").alias("node"))
    nodes = n.select(F.col("n_name").alias("node_id"), F.when(F.col("n_nationkey") % 2 == 0, "place").alias("entity_type"))
    edges = n.alias("a").join(n.alias("b"), F.expr("b.n_nationkey = a.n_nationkey + 1")).select(F.col("a.n_name").alias("src"), F.col("b.n_name").alias("dst"), F.lit("near").alias("relation_type"))
    return answers.group_context(members, nodes, edges)


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries of each region (two nations by name, two words), nations as canonical nodes, topics by remainder, edges between neighbours."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    c = n.select(F.col("n_name").alias("name"), _J("of ", F.col("r_name")).alias("entity_type"), ((k % 10) / 10).alias("confidence"), (k % 3).alias("corroboration"), F.when(k % 4 == 0, _J("key ", k.cast("string"))).alias("attributes"), F.array(_J("d", (k % 5).cast("string")), F.lit("d0")).alias("documents"))
    t = n.groupBy(_J("topic_", (k % 4).cast("string")).alias("topic")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    x = n.alias("a").join(n.alias("b"), F.expr("b.n_nationkey = (a.n_nationkey * 7 + 3) % 25")).select(F.col("a.n_name").alias("src"), F.col("b.n_name").alias("dst"), F.lit("near").alias("relation_type"), (F.col("a.n_nationkey") / 25).alias("confidence"))
    asked = n.groupBy(F.col("r_regionkey").alias("query_id")).agg(F.slice(F.array_sort(F.collect_list("n_name")), 1, 2).alias("names"), F.concat(F.lit("about united "), F.lower(F.max("n_name")), F.lit(" a b c d")).alias("query"))
    return asked, c, t, x


_CORPUS = """n AS (SELECT n_nationkey AS k, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT n_name AS name, 'of ' || r_name AS entity_type, (k % 10) / 10.0::DOUBLE AS confidence, k % 3 AS corroboration, CASE WHEN k % 4 = 0 THEN 'key ' || k END AS attributes, ['d' || (k % 5), 'd0'] AS documents, k FROM n),
t AS (SELECT 'topic_' || (k % 4) AS topic, list_sort(list(n_name)) AS members FROM n GROUP BY k % 4),
x AS (SELECT a.n_name AS src, b.n_name AS dst, a.k / 25.0::DOUBLE AS confidence FROM n a JOIN n b ON b.k = (a.k * 7 + 3) % 25),
q AS (SELECT r_regionkey AS query_id, list_sort(list(n_name))[1:2] AS names, list_sort(string_split('about united ' || lower(max(n_name)) || ' a b c d', ' ')[1:5]) AS all_words, string_split('about united ' || lower(max(n_name)) || ' a b c d', ' ')[1:5] AS words FROM n GROUP BY r_regionkey),
hits AS (SELECT query_id, name, 0 AS way, i AS ord FROM (SELECT query_id, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS i FROM q) JOIN c USING (name)
  UNION ALL SELECT query_id, name, 1, i FROM (SELECT query_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM q) JOIN (SELECT name, unnest(list_distinct(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'))) AS w FROM c) USING (w) WHERE w != ''),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY way, ord, name) AS r FROM hits) WHERE r = 1),
cn AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY way, ord, name) AS ord FROM one QUALIFY ord <= 20),
tn AS (SELECT DISTINCT query_id, topic, members FROM cn JOIN (SELECT topic, members, unnest(members) AS name FROM t) USING (name)),
xn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, src, dst) AS r FROM (SELECT DISTINCT query_id, src, dst, confidence FROM x JOIN cn ON cn.name IN (src, dst))) WHERE r <= 50)"""


@query(f"WITH {_CORPUS} SELECT query_id, ord, 'entity_profile' AS source_type, name AS id, name || ' (' || entity_type || ')' || coalesce(' — ' || attributes, '') AS content, confidence AS score FROM cn JOIN c USING (name)")
def corpus_nodes(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_results(retrieval.corpus_context(*_corpus(spark, d))[0])


@query(f"WITH {_CORPUS} SELECT query_id, src, dst, 'near' AS relation_type, confidence FROM xn")
def corpus_edges(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_context(*_corpus(spark, d))[2].select("query_id", "src", "dst", "relation_type", "confidence")


@query(f"""WITH {_CORPUS},
cl AS (SELECT query_id, len(list_distinct(flatten(list(documents)))) AS n, list('  - ' || name || ' (' || entity_type || ', corroboration=' || corroboration || ')' || coalesce(' — ' || attributes, '') ORDER BY ord)[1:10] AS l FROM cn JOIN c USING (name) GROUP BY query_id),
tl AS (SELECT query_id, list('  - ' || topic || ': ' || array_to_string(members[1:5], ', ') ORDER BY topic)[1:5] AS l FROM tn GROUP BY query_id),
xl AS (SELECT query_id, list('  - ' || src || ' —[near]→ ' || dst || ' (conf=' || printf('%.2f', confidence) || ')' ORDER BY confidence DESC, src)[1:10] AS l FROM xn GROUP BY query_id)
SELECT query_id, array_to_string(['Canonical entities from ' || n || ' documents:'] || cl.l || ['Taxonomy categories:'] || tl.l || ['Cross-document relations:'] || xl.l, chr(10)) AS text FROM cl JOIN tl USING (query_id) JOIN xl USING (query_id)""")
def corpus_text(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_block(*retrieval.corpus_context(*_corpus(spark, d)))


@query("""WITH s AS (SELECT doc_id AS document_id, coalesce(substr(text, 1, 500), '') AS head, source, lang FROM documents)
SELECT document_id, trim(head || CASE WHEN head = '' THEN '' ELSE ' ' END || 'entities: ' || array_to_string(list_sort(list_distinct([source, lang, 'x'])), ', ')) AS query FROM s""")
def agent_searches(spark: SparkSession, d: str) -> DataFrame:
    pair = F.array(F.struct(F.col("source").alias("subject"), F.col("lang").alias("object")), F.struct(F.lit("x").alias("subject"), F.col("lang").alias("object")))
    state = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("document_id"), F.col("text").alias("dense_summary"), F.lit("").alias("refine_summary"), F.array().cast("array<string>").alias("reference_titles"), pair.alias("triplets"))
    return retrieval.derive_queries(state, "concept_extractor").select("document_id", "query")


@query(f"WITH {I.EDGES} SELECT src, relation_type, dst, 2 * occurrence_count AS occurrence_count, confidence FROM edges")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    e = graph.build_edges(facts.consolidate(I.raw_facts(spark, d)))
    return graph.merge_edges(e, e).drop("source_chunk_ids")


@query("""WITH t AS (SELECT n_name || ' x' AS text, n_nationkey AS k FROM nation UNION ALL SELECT substr(lower(n_name), 2, 3), n_nationkey + 100 FROM nation UNION ALL SELECT upper(n_name), n_nationkey + 200 FROM nation UNION ALL SELECT 'zz', 300),
m AS (SELECT DISTINCT text FROM t), nodes AS (SELECT n_name AS node_id, n_nationkey AS ord FROM nation),
f AS (SELECT text, arg_min(node_id, ord) AS s FROM m JOIN nodes ON contains(lower(node_id), lower(text)) OR contains(lower(text), lower(node_id)) GROUP BY text)
SELECT m.text, coalesce(e.node_id, s) AS node_id FROM m LEFT JOIN f USING (text) LEFT JOIN nodes e ON e.node_id = m.text""")
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Texts against nation names, each contained in the other in some way, or in none."""
    n = table(spark, d, "nation")
    texts = n.select(_J(F.col("n_name"), " x").alias("text")).union(n.select(F.substring(F.lower("n_name"), 2, 3))).union(n.select(F.upper("n_name"))).union(spark.createDataFrame([("zz",)], "text string"))
    none = spark.createDataFrame([], "alias string, canonical string")
    return references.match_nodes(texts, n.select(F.col("n_name").alias("node_id"), F.col("n_nationkey").alias("ord")), none)


@query(f"""WITH {I.RAW}, a AS (SELECT s_name AS canonical FROM supplier), f AS (SELECT trim(subject) AS s, object AS o FROM raw)
SELECT CASE WHEN s = 'FRANCE' THEN 'REPUBLIC' ELSE s END AS subject, CASE WHEN trim(o) = 'EUROPE' THEN 'CONTINENT' WHEN trim(o) = 'FRANCE' THEN 'REPUBLIC' ELSE trim(o) END AS object, count(*) AS n FROM f GROUP BY 1, 2""")
def alias_substitution(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("FRANCE", "REPUBLIC"), ("EUROPE", "CONTINENT")], "alias string, canonical string")
    return facts.substitute(I.raw_facts(spark, d), aliases).groupBy("subject", "object").agg(F.count("*").alias("n"))


@query("""WITH segs AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE NOT contains(text, chr(10))),
fold AS (WITH RECURSIVE f AS (SELECT conv_id, i, seg, 0 AS chunk, length(seg) AS size, [seg] AS open, false AS flushed FROM segs WHERE i = 1
  UNION ALL SELECT s.conv_id, s.i, s.seg, CASE WHEN f.size + length(s.seg) > 200 THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.size + length(s.seg) > 200 THEN CASE WHEN length(f.seg) <= 60 THEN length(f.seg) ELSE 0 END ELSE f.size END + length(s.seg),
    CASE WHEN f.size + length(s.seg) > 200 THEN CASE WHEN length(f.seg) <= 60 THEN [f.seg] ELSE [] END ELSE f.open END || [s.seg], f.size + length(s.seg) > 200
  FROM f JOIN segs s ON s.conv_id = f.conv_id AND s.i = f.i + 1) SELECT * FROM f)
SELECT conv_id, chunk::INT AS position, array_to_string(arg_max(open, i), chr(10) || chr(10)) AS content FROM fold GROUP BY conv_id, chunk""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation packed with an overlap of a short last segment."""
    c = table(spark, d, "conversations").filter(~F.contains("text", F.lit("\n")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")))), lambda x: x["t"])
    return c.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.posexplode(chunking.pack(F.col("p"), 200, 60)).alias("position", "content"))


@query("""WITH v AS (SELECT vec_id, vec_id // 3 AS doc, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 3 != 0 OR vec_id % 2 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, lag(e) OVER (PARTITION BY doc ORDER BY vec_id) AS b FROM v),
g AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND list_cosine_similarity(b, e) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY vec_id) AS grp FROM n)
SELECT doc, CASE WHEN n < 3 THEN 0 ELSE grp END::BIGINT AS position, string_agg('part ' || vec_id, chr(10) || chr(10) ORDER BY vec_id) AS content FROM g GROUP BY ALL""")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parts of small documents: those of two parts are packed, those of three cut where the meaning turns."""
    v = table(spark, d, "embeddings").filter("vec_id % 3 != 0 or vec_id % 2 = 0")
    parts = v.select(F.floor(F.col("vec_id") / 3).alias("doc"), "vec_id", _J("part ", F.col("vec_id").cast("string")).alias("t"), "embedding")
    return chunking.semantic(parts, "doc", "vec_id", "t", "embedding", 0.05)


@query("""WITH e AS (SELECT 'S' || s_suppkey AS canonical_name, s_suppkey AS k FROM supplier), v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT 'N' || a.vec_id AS name, 'S' || b.vec_id AS target, list_cosine_similarity(a.x, b.x) AS s, b.vec_id AS bk FROM v a JOIN v b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
near AS (SELECT name, arg_max(target, s) AS target, max(s) AS s FROM l GROUP BY name)
SELECT CASE WHEN vec_id % 4 = 1 THEN 'S' || (vec_id - 1) ELSE 'N' || vec_id END AS canonical_name, CASE WHEN vec_id % 4 = 1 THEN 'S' || (vec_id - 1) WHEN s >= 0.3 THEN target END AS target, CASE WHEN vec_id % 4 = 1 THEN 'name' WHEN s >= 0.3 THEN 'embedding' END AS how FROM v JOIN near ON name = 'N' || vec_id WHERE vec_id % 2 = 1""")
def link_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Names first, then the nearest embedding of what is left."""
    v = table(spark, d, "embeddings")
    k, none = F.col("vec_id"), F.array().cast("array<string>").alias("aliases")
    known = v.filter("vec_id % 2 = 0").select(_J("S", k.cast("string")).alias("canonical_name"), none, "embedding")
    new = v.filter("vec_id % 2 = 1").select(F.when(k % 4 == 1, _J("S", (k - 1).cast("string"))).otherwise(_J("N", k.cast("string"))).alias("canonical_name"), none, "embedding")
    return entities.link(known, new, 0.3)


@query()
def vector_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all, by inverted lists."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.search(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), v, 5).withColumn("score", F.round("score", 6))


@query("SELECT n_nationkey AS query_id, n_name AS node FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def seed_choice(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a walk: of each query's results the nodes over the limit."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    row = lambda i, rank, score: n.select(k.alias("query_id"), i.alias("id"), F.lit(rank).alias("rank"), score.alias("score"))
    results = row(F.col("n_name"), 1, F.when(k % 2 == 0, 0.9).otherwise(0.3)).unionByName(row(F.col("r_name"), 2, F.when(k % 3 == 0, 0.31).otherwise(0.1))).unionByName(row(F.lit("no node"), 3, F.lit(0.9)))
    nodes = n.select(F.col("n_name").alias("node_id")).union(n.select("r_name"))
    return retrieval.seeds_of(results, nodes)


@query(f"WITH {I.NODES} SELECT node_id, occurrence_count FROM nodes WHERE layer = 3 AND occurrence_count = 1")
def node_selection(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.build_nodes(facts.consolidate(I.raw_facts(spark, d)))
    return graph.select_nodes(nodes, {"layer": 3, "occurrence_count": 1}).select("node_id", "occurrence_count")


@query(f"""WITH {I.CALLS}, s AS (SELECT document_id, sum(calls)::BIGINT AS c, sum(t)::BIGINT AS t, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM agents GROUP BY document_id)
SELECT document_id, 'Calls    : ' || c AS calls, 'Tokens   : ' || format('{{:,}}', t) || ' (in ' || format('{{:,}}', i) || ', out ' || format('{{:,}}', o) || ')' AS tokens FROM s""")
def session_reports(spark: SparkSession, d: str) -> DataFrame:
    """Two lines of each session's text."""
    priced = tracking.priced(I.calls(spark, d), I.prices(spark))
    out = reports.session_text(tracking.sessions(priced, 100), tracking.by_agent(priced, 100, ("document_id",)))
    cut = F.split("text", "\n")
    return out.select("document_id", cut[2].alias("calls"), cut[3].alias("tokens"))


@query("SELECT DISTINCT 'doc' AS kind, source AS key, min(doc_id) OVER (PARTITION BY source) AS doc_id FROM documents")
def first_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("source").alias("key"), "doc_id")
    return retrieval.keep_first(rows, ["key"], ["doc_id"])


@query()
def chunk_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of each document with those of its longer sentences."""
    return spread(table(spark, d, "documents")).select("doc_id", F.inline(F.array(X.chunk_languages(F.col("text")))))


@query()
def stub_images(spark: SparkSession, d: str) -> DataFrame:
    """Pages as images for a model that sees none."""
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit("image/png").alias("media_type"))
    return models.analyze_images(p, models.StubClient).select("page_id", "type", "description")


@query("SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1")
def first_of_content(spark: SparkSession, d: str) -> DataFrame:
    """The least document of each content."""
    rows = spread(table(spark, d, "documents")).select("doc_id", X.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return dedup.duplicates(rows, "doc_id", "content_hash").filter("doc_id = keep_id").select("doc_id").join(rows, "doc_id")
