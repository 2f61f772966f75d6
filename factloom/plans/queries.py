"""The registered queries: each a thin use of operators, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed, maths
from factloom.functions import text as X
from factloom.operators import chunking, communities, dedup, entities, facts, graph, models, modularity_moves, reasoning, references, retrieval, structure, tracking
from factloom.plans import inputs as I
from factloom.plans.stages import levels
from factloom.shared import settle, spread, table
from factloom.sources.readers import html_strings, oversize
from factloom.sources.stores import diff_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _cons(spark: SparkSession, d: str) -> DataFrame:
    return facts.consolidate(I.raw_facts(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_edges(_cons(spark, d))


# --- facts


@query(f"WITH {I.CONS} SELECT * FROM cons")
def triplet_consolidation(spark: SparkSession, d: str) -> DataFrame:
    return _cons(spark, d)


@query(f"WITH {I.RAW}, m AS (SELECT trim(subject) AS entity, source_chunk_id FROM raw UNION ALL SELECT trim(object), source_chunk_id FROM raw) SELECT entity, count(*) AS occurrence_count, list_sort(list(DISTINCT source_chunk_id)) AS source_chunk_ids FROM m WHERE entity != '' GROUP BY entity")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return facts.entity_mentions(I.raw_facts(spark, d))


@query(f"WITH {I.RAW} SELECT DISTINCT predicate, {I.canonical_sql('predicate')} AS canonical FROM raw")
def relation_mapping(spark: SparkSession, d: str) -> DataFrame:
    return facts.relation_mapping(I.raw_facts(spark, d))


@query(f"WITH {I.RAW}, x AS (SELECT DISTINCT predicate, {I.canonical_sql('predicate')} AS c FROM raw) SELECT c AS canonical, list_sort(list(predicate)) AS forms FROM x WHERE c IN ('buys_in', 'has_balance') GROUP BY c")
def taxonomy_extension(spark: SparkSession, d: str) -> DataFrame:
    return facts.extended_taxonomy(I.raw_facts(spark, d)).filter("category = 'extended'").select("canonical", "forms")


@query(f"WITH {I.RAW}, x AS (SELECT subject, predicate, k, v, min(seq) AS s FROM (SELECT subject, predicate, seq, 'chunk' AS k, source_chunk_id AS v FROM raw UNION ALL SELECT subject, predicate, seq, 'object', object FROM raw) GROUP BY subject, predicate, k, v) SELECT subject, predicate, max(CASE WHEN k = 'chunk' THEN vs END) AS chunks, max(CASE WHEN k = 'object' THEN vs END) AS objects FROM (SELECT subject, predicate, k, string_agg(v, ',' ORDER BY s) AS vs FROM x GROUP BY ALL) GROUP BY subject, predicate")
def qualifier_merge(spark: SparkSession, d: str) -> DataFrame:
    raw = I.raw_facts(spark, d).withColumn("qualifiers", F.create_map(F.lit("chunk"), F.col("source_chunk_id"), F.lit("object"), F.col("object")))
    m = facts.merge_qualifiers(raw, ("subject", "predicate"))
    return m.select("subject", "predicate", F.array_join(F.col("qualifiers")["chunk"], ",").alias("chunks"), F.array_join(F.col("qualifiers")["object"], ",").alias("objects"))


@query(f"WITH {I.CONS}, u(tag, s, o, p) AS (SELECT 'b', trim(subject), trim(object), predicate FROM raw UNION ALL SELECT 'a', subject, object, predicate FROM cons) SELECT (SELECT count(*) FROM u WHERE tag = 'b') AS facts_before, (SELECT count(*) FROM u WHERE tag = 'a') AS facts_after, (SELECT count(DISTINCT p) FROM u WHERE tag = 'b') AS relations_before, (SELECT count(DISTINCT p) FROM u WHERE tag = 'a') AS relations_after, (SELECT count(DISTINCT e) FROM (SELECT unnest([s, o]) AS e FROM u WHERE tag = 'b')) AS entities_before, (SELECT count(DISTINCT e) FROM (SELECT unnest([s, o]) AS e FROM u WHERE tag = 'a')) AS entities_after, round(1 - (SELECT count(*) FROM u WHERE tag = 'a')::DOUBLE / (SELECT count(*) FROM u WHERE tag = 'b'), 4) AS dedup_ratio")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return facts.merge_stats(I.raw_facts(spark, d), _cons(spark, d))


@query(f"WITH {I.RAW} SELECT DISTINCT object, (object != '' AND ({I.LITERAL('trim(object)')})) AS is_literal FROM raw")
def literal_flag(spark: SparkSession, d: str) -> DataFrame:
    return I.raw_facts(spark, d).select("object").distinct().select("object", X.is_literal(F.col("object")).alias("is_literal"))


@query(f"WITH {I.RAW} SELECT seq, substr(sha256(lower(trim(subject)) || '|' || lower(trim(predicate)) || '|' || lower(trim(object))), 1, 16) AS key FROM raw")
def triplet_key(spark: SparkSession, d: str) -> DataFrame:
    return I.raw_facts(spark, d).select("seq", X.triplet_key(F.col("subject"), F.col("predicate"), F.col("object")).alias("key"))


# --- fingerprints and duplicates


@query(f"SELECT doc_id, sha256(text) AS exact_hash, sha256({I.NORM('text')}) AS content_hash, length(text) // 4 AS tokens FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.exact_hash(F.col("text")).alias("exact_hash"), X.content_hash(F.col("text")).alias("content_hash"), X.tokens(F.col("text")).alias("tokens"))


@query(f"WITH {I.SIMHASH} SELECT doc_id, lower(printf('%016x', sh)) AS simhash_hex FROM simhash")
def simhash(spark: SparkSession, d: str) -> DataFrame:
    return X.simhash(_docs(spark, d), "doc_id", "text").select("doc_id", "simhash_hex")


@query("SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates(_docs(spark, d).withColumn("h", X.exact_hash(F.col("text"))), "doc_id", "h")


@query(f"SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS copies FROM (SELECT doc_id, {I.NORM('text')} AS n FROM documents) WINDOW w AS (PARTITION BY n)")
def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates(_docs(spark, d).withColumn("h", X.content_hash(F.col("text"))), "doc_id", "h")


@query(f"WITH documents AS (SELECT 2 * doc_id AS doc_id, text FROM main.documents UNION ALL SELECT 2 * doc_id + 1, regexp_replace(text, '[ \\n]+[^ \\n]*$', '') FROM main.documents), {I.SIMHASH}, r AS (SELECT sh, min(doc_id) AS id FROM simhash GROUP BY sh) SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.sh, b.sh)::BIT)::INT AS distance FROM r a JOIN r b ON a.id < b.id WHERE bit_count(xor(a.sh, b.sh)::BIT) <= 3")
def near_duplicates_simhash(spark: SparkSession, d: str) -> DataFrame:
    """All documents and a copy of each without its last word."""
    docs = _docs(spark, d).select("doc_id", "text")
    copies = docs.select((2 * F.col("doc_id")).alias("doc_id"), "text").union(docs.select(2 * F.col("doc_id") + 1, F.regexp_replace("text", r"[ \n]+[^ \n]*\z", "")))
    reps = settle(X.simhash(copies, "doc_id", "text").groupBy("simhash").agg(F.min("doc_id").alias("id")), "simhashes")
    return dedup.near_matches(reps, reps).filter("id_a < id_b")


def _split_cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = dedup.fingerprints(_docs(spark, d), "doc_id", "text")
    return f.filter("doc_id % 2 = 1"), f.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "document_id")


_SPLIT = f"h AS (SELECT doc_id, sha256(text) AS e, sha256({I.NORM('text')}) AS c FROM documents), ce AS (SELECT e, min(doc_id) AS m FROM h WHERE doc_id % 2 = 0 GROUP BY e), cc AS (SELECT c, min(doc_id) AS m FROM h WHERE doc_id % 2 = 0 GROUP BY c), first AS (SELECT h.doc_id, CASE WHEN ce.m IS NOT NULL THEN 'exact' WHEN cc.m IS NOT NULL THEN 'content' ELSE 'new' END AS cache_status, coalesce(ce.m, cc.m) AS matched_document FROM h LEFT JOIN ce USING (e) LEFT JOIN cc USING (c) WHERE h.doc_id % 2 = 1)"


@query(f"WITH {_SPLIT} SELECT * FROM first")
def dedup_cascade(spark: SparkSession, d: str) -> DataFrame:
    new, cache = _split_cache(spark, d)
    return dedup.cascade(new, cache, "doc_id")


@query(f"WITH {_SPLIT}, {I.SIMHASH}, near AS (SELECT a.doc_id, min({{'d': bit_count(xor(a.sh, b.sh)::BIT)::INT, 'm': b.doc_id}}) AS x FROM simhash a JOIN simhash b ON b.doc_id % 2 = 0 AND bit_count(xor(a.sh, b.sh)::BIT) <= 3 WHERE a.doc_id IN (SELECT doc_id FROM first WHERE cache_status = 'new') GROUP BY a.doc_id) SELECT doc_id, CASE WHEN cache_status != 'new' THEN cache_status WHEN x IS NOT NULL THEN 'structural' ELSE 'none' END AS hit_level, coalesce(matched_document, x.m) AS matched_document, CASE WHEN cache_status != 'new' THEN 1.0 WHEN x IS NOT NULL THEN 1 - x.d / 64.0 ELSE 0.0 END::DOUBLE AS similarity, cache_status != 'new' AS reusable FROM first LEFT JOIN near USING (doc_id)")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    new, cache = _split_cache(spark, d)
    return dedup.cache_lookup(new, cache, "doc_id")


# --- chunks and structure


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.structural(_docs(spark, d), "doc_id", "text", 400, 0, "\n")


@query(f"WITH RECURSIVE {I.SEGMENTS} SELECT doc_id, position, content FROM packed")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "position", "content")


@query(f"WITH RECURSIVE {I.SEGMENTS} SELECT doc_id, position, id, fingerprint, char_count, word_count, token_count_est, (sum(b) OVER w - b)::BIGINT AS byte_offset_start, (sum(b) OVER w)::BIGINT AS byte_offset_end, lag(id) OVER w AS preceding_chunk_id, lead(id) OVER w AS following_chunk_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY position)")
def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).drop("content", "content_type")


@query(f"WITH RECURSIVE {I.SEGMENTS} SELECT doc_id, position, coalesce(string_agg('[' || id || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM chunks")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sliding_context(_chunks(spark, d), "doc_id").select("doc_id", "position", "context")


@query(f"WITH RECURSIVE {I.SEGMENTS}, fp AS (SELECT doc_id, id, char_count, row_number() OVER (PARTITION BY doc_id, fingerprint ORDER BY position) AS r FROM chunks) SELECT doc_id, id, 'warning' AS level, issue FROM (SELECT doc_id, id, 'duplicate fingerprint' AS issue FROM fp WHERE r > 1 UNION ALL SELECT doc_id, id, 'too long' FROM fp WHERE char_count > 380 UNION ALL SELECT doc_id, id, 'too short' FROM fp WHERE char_count < 100)")
def chunk_validation(spark: SparkSession, d: str) -> DataFrame:
    return chunking.validate(_chunks(spark, d), "doc_id", 380, 100)


def _word(w: str) -> str:
    return f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')::INT"


_LANG = f"""x AS (SELECT doc_id, substr(text, 1, 3000) AS head, lower(substr(text, 1, 3000)) AS low FROM documents),
s AS (SELECT doc_id, {" + ".join(map(_word, fixed.ENGLISH))} AS en, {" + ".join(map(_word, fixed.GERMAN))} AS de,
 {" + ".join(map(_word, fixed.FRENCH))} + CASE WHEN length(regexp_replace(low, '[^{fixed.FRENCH_LETTERS}]', '', 'g')) >= 2 THEN 2 * length(regexp_replace(low, '[^{fixed.FRENCH_LETTERS}]', '', 'g')) ELSE 0 END
 + 3 * len(regexp_extract_all(head, '(?:^|[^\\p{{L}}\\p{{N}}_])[lLdDnNsS]''|qu''|j''')) AS fr FROM x)"""


@query(f"WITH {_LANG} SELECT doc_id, CASE WHEN en = greatest(en, fr, de) THEN 'en' WHEN fr = greatest(en, fr, de) THEN 'fr' ELSE 'de' END AS language FROM s")
def language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.detect_language(F.col("text")).alias("language"))


@query(f"WITH {_LANG} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xx' WHEN doc_id % 3 = 1 THEN lang WHEN en = greatest(en, fr, de) THEN 'en' WHEN fr = greatest(en, fr, de) THEN 'fr' ELSE 'de' END AS language FROM s JOIN documents USING (doc_id)")
def language_choice(spark: SparkSession, d: str) -> DataFrame:
    over = F.when(F.col("doc_id") % 3 == 0, "xx").otherwise("")
    meta = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return _docs(spark, d).select("doc_id", X.document_language(over, meta, F.col("text")).alias("language"))


_H = [p.replace("'", "''") for p in fixed.HEADINGS]


@query(f"""WITH {I.MARKED}, t AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
h AS (SELECT *, CASE WHEN regexp_matches(s, '(?i){_H[0]}') THEN length(regexp_extract(s, '{_H[0]}', 1)) WHEN regexp_matches(s, '{_H[1]}') THEN length(regexp_replace(regexp_extract(s, '{_H[1]}', 1), '[^.]', '', 'g')) + 1
 WHEN regexp_matches(s, '(?i){_H[2]}') OR regexp_matches(s, '(?i){_H[3]}') THEN 1 END AS level FROM t WHERE s != '' AND length(s) <= 200)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ord, s AS title, level, strpos(text, line) - 1 AS start_position, strpos(text, line) - 1 + length(line) AS end_position FROM h WHERE level IS NOT NULL""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return structure.sections(I.marked_up(spark, d), "doc_id", "text")


@query(f"WITH {I.MARKED} SELECT doc_id, 'fn_' || regexp_extract(line, '^\\[(\\d+)\\]\\s+(.+)$', 1) AS footnote_id, trim(regexp_extract(line, '^\\[(\\d+)\\]\\s+(.+)$', 2)) AS content, line_no FROM lines WHERE regexp_matches(line, '^\\[(\\d+)\\]\\s+(.+)$')")
def footnotes(spark: SparkSession, d: str) -> DataFrame:
    return structure.footnotes(I.marked_up(spark, d), "doc_id", "text")


@query(f"WITH {I.MARKED}, r AS (SELECT doc_id, line_no, trim(line) AS r, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines WHERE trim(line) LIKE '|%' AND trim(line) LIKE '%|'), b AS (SELECT doc_id, min(line_no) AS pos, string_agg(r, chr(10) ORDER BY line_no) AS content_markdown FROM r GROUP BY doc_id, g HAVING count(*) >= 2 AND max(regexp_matches(r, '^\\|[\\s\\-:|]+\\|$')::INT) = 1) SELECT doc_id, printf('tbl_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS table_id, content_markdown FROM b")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return structure.tables(I.marked_up(spark, d), "doc_id", "text")


@query(f"WITH {I.MARKED} SELECT doc_id, true AS has_toc, true AS has_bibliography, strpos(text, '## References') - 1 AS bibliography_position, false AS has_index FROM md")
def structure_flags(spark: SparkSession, d: str) -> DataFrame:
    return structure.flags(I.marked_up(spark, d), "doc_id", "text")


@query("SELECT n_nationkey, '| ' || n_name || ' | ' || r_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' |  |' AS md FROM nation JOIN region ON n_regionkey = r_regionkey")
def table_rendering(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array(F.array("n_name", "r_name"), F.array(F.col("n_nationkey").cast("string")))
    return n.select("n_nationkey", structure.markdown_table(rows).alias("md"))


@query("SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '<<<IMAGE_CONTENT id=\"img_' || doc_id || '\">>>' || chr(10) || lang || chr(10) || '<<<END_IMAGE_CONTENT>>>' ELSE '' END AS merged FROM documents")
def content_merge(spark: SparkSession, d: str) -> DataFrame:
    b = F.when(F.col("doc_id") % 2 == 0, structure.block("IMAGE", F.concat(F.lit("img_"), F.col("doc_id").cast("string")), F.col("lang")))
    return _docs(spark, d).select("doc_id", structure.merge_content(F.col("text"), F.array(b)).alias("merged"))


@query("WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT *, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v), c AS (SELECT vec_id, label, CASE WHEN b IS NOT NULL AND list_cosine_similarity(b, e) < 0.05 THEN 1 ELSE 0 END AS cut FROM p) SELECT label, vec_id, (sum(cut) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS \"group\" FROM c")
def semantic_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_groups(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.05).select("label", "vec_id", "group")


@query("SELECT doc_id, length(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) ELSE text END) AS n FROM documents")
def oversize_truncate(spark: SparkSession, d: str) -> DataFrame:
    return oversize(_docs(spark, d), "text", 1000).select("doc_id", F.length("text").alias("n"))


@query()
def html_strings_text(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "text": [html_strings(h)[0] for h in pdf["html"]]})

    return table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, text string")


# --- graph


@query(f"WITH {I.NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_nodes(_cons(spark, d))


@query(f"WITH {I.EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, (min({{'n': -confidence, 'r': relation_type}})).r AS relation_type, max(confidence) AS confidence, list_sort(list(DISTINCT relation_type)) AS relations, sum(occurrence_count)::BIGINT AS occurrence_count FROM edges GROUP BY 1, 2")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.collapse(_edges(spark, d))


@query(f"WITH {I.NODES} SELECT layer, count(*) AS nodes, sum(occurrence_count)::BIGINT AS mentions FROM nodes GROUP BY layer")
def layer_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.layer_stats(graph.build_nodes(_cons(spark, d)))


@query(f"WITH {I.EDGES} SELECT src, dst, relation_type FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE layer = 2) AND dst IN (SELECT node_id FROM nodes WHERE layer = 2)")
def layer_subgraph(spark: SparkSession, d: str) -> DataFrame:
    t = _cons(spark, d)
    return graph.layer_subgraph(graph.build_nodes(t), graph.build_edges(t))[1].select("src", "dst", "relation_type")


@query(f"WITH {I.EDGES}, u AS (SELECT src AS a, dst AS b FROM edges WHERE src != dst UNION SELECT dst, src FROM edges WHERE src != dst), h1 AS (SELECT r_name AS start, b AS node FROM region JOIN u ON a = r_name), h2 AS (SELECT DISTINCT start, b AS node FROM h1 JOIN u ON a = h1.node), allh AS (SELECT start, start AS node, 0 AS hops FROM h1 UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2) SELECT start, node, min(hops) AS hops FROM allh GROUP BY start, node HAVING min(hops) > 0")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, d), table(spark, d, "region").select(F.col("r_name").alias("start")), 2)


@query(f"WITH {I.EDGES} SELECT src, dst, relation_type FROM edges WHERE src NOT IN (SELECT r_name FROM region) AND dst NOT IN (SELECT r_name FROM region)")
def node_delete(spark: SparkSession, d: str) -> DataFrame:
    t = _cons(spark, d)
    gone = table(spark, d, "region").select(F.col("r_name").alias("node_id"))
    return graph.drop_nodes(graph.build_nodes(t), graph.build_edges(t), gone)[1].select("src", "dst", "relation_type")


@query(f"WITH {I.NODES} SELECT node_id, (occurrence_count * 2)::BIGINT AS occurrence_count, source_chunk_ids, confidence FROM nodes")
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    n = graph.build_nodes(_cons(spark, d)).select("node_id", "occurrence_count", "source_chunk_ids", "confidence")
    return graph.merge_graph(n, n)


@query(f"WITH {I.NODES}, k AS (SELECT node_id, list_filter(source_chunk_ids, lambda c: c > 'chunk_024') AS source_chunk_ids FROM nodes) SELECT * FROM k WHERE len(source_chunk_ids) > 0")
def graph_remove_document(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.range(25).select(F.format_string("chunk_%03d", "id").alias("source_chunk_id"))
    return graph.remove_document(graph.build_nodes(_cons(spark, d)), gone).select("node_id", "source_chunk_ids")


@query("""WITH ex AS (SELECT s_name AS n, [upper(s_name), s_name || ' Inc'] AS al FROM supplier WHERE s_suppkey % 2 = 0),
inc AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) WHEN s_suppkey % 3 = 1 THEN s_name || ' Inc' ELSE s_name || ' Ltd' END AS canonical_name, [lower(s_name)] AS al FROM supplier)
SELECT canonical_name, (SELECT n FROM ex WHERE lower(n) = lower(canonical_name) OR lower(canonical_name) IN (lower(al[1]), lower(al[2])) OR lower(n) = inc.al[1]) AS target,
CASE WHEN EXISTS (SELECT 1 FROM ex WHERE lower(n) = lower(canonical_name)) THEN 'name' WHEN EXISTS (SELECT 1 FROM ex WHERE lower(canonical_name) IN (lower(al[1]), lower(al[2]))) THEN 'alias' WHEN EXISTS (SELECT 1 FROM ex WHERE lower(n) = inc.al[1]) THEN 'incoming alias' END AS how FROM inc""")
def entity_link(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    ex = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("canonical_name"), F.array(F.upper("s_name"), F.concat("s_name", F.lit(" Inc"))).alias("aliases"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.upper("s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" Inc"))).otherwise(F.concat("s_name", F.lit(" Ltd")))
    return entities.link_by_name(ex, s.select(name.alias("canonical_name"), F.array(F.lower("s_name")).alias("aliases")))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT a.id AS l, b.id AS r, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id % 2 = 1 AND b.id % 2 = 0),
b AS (SELECT l, max_by(r, s) AS r, max(s) AS s FROM x GROUP BY l) SELECT l AS left_id, r AS right_id, round(s, 6) AS similarity FROM b WHERE s >= 0.3""")
def nearest_link(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return entities.nearest(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), 0.3).withColumn("similarity", F.round("similarity", 6))


@query()
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.format_string("v%06d", "vec_id").alias("name"), "embedding")
    return entities.leader_clusters(v, 0.2)


@query("WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return entities.similar_pairs(v, 0.3, "label").withColumn("similarity", F.round("similarity", 6))


# --- communities


def _nation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).filter("relation_type in ('part_of', 'located_in')")


# every node here hangs below a region, so two rounds of minima over the tree are enough for the oracle
_CC = f"{I.EDGES}, top AS (SELECT n_name AS node, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION SELECT c_name, r_name FROM c), used AS (SELECT src AS node FROM edges WHERE relation_type IN ('part_of', 'located_in') UNION SELECT dst FROM edges WHERE relation_type IN ('part_of', 'located_in')), comp AS (SELECT node, min(node) OVER (PARTITION BY r) AS component FROM top JOIN used USING (node))"


@query(f"WITH {_CC} SELECT node, component FROM comp")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return communities.components(_nation_edges(spark, d))


@query(f"WITH {_CC}, s AS (SELECT component, count(*) AS size, min(node) AS f FROM comp GROUP BY component HAVING count(*) >= 3), n AS (SELECT component, size, row_number() OVER (ORDER BY f) - 1 AS i FROM s) SELECT 'community_' || i AS community_id, node, size FROM comp JOIN n USING (component)")
def communities_kept(spark: SparkSession, d: str) -> DataFrame:
    return communities.keep_large(communities.components(_nation_edges(spark, d)))


_NM = "members AS (SELECT DISTINCT node_id AS node, coalesce(n_regionkey, 9)::INT AS component FROM nodes LEFT JOIN (SELECT c_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, n_regionkey FROM nation UNION SELECT r_name, r_regionkey FROM region) x ON node_id = c_name)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("x"), "n_regionkey")
    of = c.union(n.select("n_name", "n_regionkey")).union(table(spark, d, "region").select("r_name", "r_regionkey")).distinct()
    nodes = graph.build_nodes(_cons(spark, d))
    return nodes.join(of, F.col("node_id") == F.col("x"), "left").select(F.col("node_id").alias("node"), F.coalesce("n_regionkey", F.lit(9)).cast("int").alias("component")).distinct()


@query(f"WITH {I.EDGES}, {_NM}, u AS (SELECT src AS a, dst AS b FROM edges WHERE src != dst UNION SELECT dst, src FROM edges WHERE src != dst), t AS (SELECT x.component AS c, count(*) AS deg, sum((x.component = y.component)::INT) AS ins FROM u JOIN members x ON a = x.node JOIN members y ON b = y.node GROUP BY 1) SELECT round(sum(ins / (SELECT sum(deg) FROM t) - pow(deg / (SELECT sum(deg) FROM t), 2)), 6) AS modularity FROM t")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    return communities.modularity(_members(spark, d), _edges(spark, d))


@query(f"WITH {I.NODES}, {_NM} SELECT component, list_sort(list(DISTINCT ch)) AS chunks FROM (SELECT component, unnest(source_chunk_ids) AS ch FROM members JOIN nodes ON node = node_id) GROUP BY component")
def community_coverage(spark: SparkSession, d: str) -> DataFrame:
    return communities.coverage(_members(spark, d), graph.build_nodes(_cons(spark, d)))


@query(f"WITH {I.NODES}, {_NM}, k AS (SELECT component AS c, list(DISTINCT ch) AS chunks FROM (SELECT component, unnest(source_chunk_ids) AS ch FROM members JOIN nodes ON node = node_id) GROUP BY component) SELECT a.c AS a, b.c AS b, len(list_intersect(a.chunks, b.chunks)) AS shared, len(list_intersect(a.chunks, b.chunks)) / greatest(len(a.chunks), len(b.chunks))::DOUBLE AS weight FROM k a JOIN k b ON a.c < b.c WHERE len(list_intersect(a.chunks, b.chunks)) >= 3")
def community_overlap(spark: SparkSession, d: str) -> DataFrame:
    return communities.overlaps(communities.coverage(_members(spark, d), graph.build_nodes(_cons(spark, d))))


@query(f"WITH {I.EDGES}, {_NM}, r AS (SELECT e.src, e.dst, e.relation_type, x.component, row_number() OVER (PARTITION BY x.component ORDER BY e.confidence DESC, e.src, e.dst, e.relation_type) AS n FROM edges e JOIN members x ON e.src = x.node JOIN members y ON e.dst = y.node AND y.component = x.component) SELECT component, src, dst, relation_type FROM r WHERE n <= 15")
def community_edges(spark: SparkSession, d: str) -> DataFrame:
    return communities.intra_edges(_edges(spark, d), _members(spark, d)).select("component", "src", "dst", "relation_type")


@query(f"WITH {I.EDGES} SELECT node, list_sort(list(DISTINCT t)) AS relations FROM (SELECT src AS node, src || ' ' || relation_type || ' ' || dst AS t FROM edges UNION ALL SELECT dst, src || ' ' || relation_type || ' ' || dst FROM edges) GROUP BY node")
def entity_relations(spark: SparkSession, d: str) -> DataFrame:
    return communities.neighbours_text(_edges(spark, d))


@query("WITH cl AS (SELECT n_regionkey AS cluster, n_name AS member FROM nation), ex AS (SELECT 'topic_' || (n_nationkey % 3) AS topic, n_name AS member FROM nation WHERE n_nationkey < 15), v AS (SELECT cluster, topic, count(*) AS v FROM cl JOIN ex USING (member) GROUP BY ALL), b AS (SELECT cluster, min({'n': -v, 't': topic}) AS b FROM v GROUP BY cluster), s AS (SELECT cluster, count(*) AS n, min(member) AS f, string_agg(member, '_' ORDER BY member) AS names FROM cl GROUP BY cluster) SELECT cluster, CASE WHEN b IS NOT NULL AND -b.n >= n // 2 THEN b.t WHEN n <= 3 THEN 'cluster_' || names ELSE 'cluster_' || n || '_' || f END AS target, CASE WHEN b IS NOT NULL AND -b.n >= n // 2 THEN 'update' ELSE 'create' END AS action FROM s LEFT JOIN b USING (cluster)")
def topic_reconcile(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    ex = n.filter("n_nationkey < 15").select(F.concat(F.lit("topic_"), (F.col("n_nationkey") % 3).cast("string")).alias("topic"), F.col("n_name").alias("member"))
    return communities.reconcile(n.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("member")), ex)


@query()
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return communities.label_propagation(_edges(spark, d))


@query()
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    """Leiden groups of the whole graph."""
    return modularity_moves.communities(_edges(spark, d), rounds=6)


# --- reasoning


def _part_of(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    up = c.select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.lit("part_of").alias("relation_type"), F.lit(0.8).alias("confidence"))
    return up.union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.lit("part_of"), F.lit(0.9)))


@query("SELECT c_name AS src, r_name AS dst, 'part_of' AS relation_type, round(0.8::DOUBLE * 0.9::DOUBLE * 0.7::DOUBLE, 4) AS confidence, [c_name, n_name, r_name] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def infer_transitive(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.infer_transitive(_part_of(spark, d))


@query("SELECT n_name AS src, c_name AS dst, 'contains' AS relation_type, round(0.8::DOUBLE * 0.7::DOUBLE, 4) AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name, n_name, 'contains', round(0.9::DOUBLE * 0.7::DOUBLE, 4) FROM nation JOIN region ON n_regionkey = r_regionkey")
def infer_inverse(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.infer_inverse(_part_of(spark, d))


@query("SELECT c_name AS src, r_name AS dst, round(0.8::DOUBLE * 0.9::DOUBLE * 0.7::DOUBLE, 4) AS confidence, 'member_of' AS relation_type FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def infer_membership(spark: SparkSession, d: str) -> DataFrame:
    e = _part_of(spark, d)
    return reasoning.infer_membership(e.withColumn("relation_type", F.when(F.col("confidence") == 0.8, "member_of").otherwise("part_of")))


@query("SELECT c_name AS src, r_name AS dst, 'transitivity' AS rule FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, c_name, 'inverse' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name, n_name, 'inverse' FROM nation JOIN region ON n_regionkey = r_regionkey")
def run_inference(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.run_inference(_part_of(spark, d)).select("src", "dst", "rule")


@query("WITH a AS (SELECT o_orderkey, 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE AS c, greatest(0.0, (epoch_us(TIMESTAMP '1998-08-02 00:00:00') - epoch_us(o_orderdate)) / 86400e6) AS age FROM orders), f AS (SELECT *, CASE WHEN age <= 0 THEN 1.0 ELSE greatest(0.05, pow(2.0, -age / 365.0)) END AS fac FROM a) SELECT o_orderkey, round(fac, 6)::DOUBLE AS decay_factor, round(greatest(0.05, c * fac), 6)::DOUBLE AS confidence FROM f")
def decay(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.lit(0.5) + (F.col("o_orderkey") % 50) / 100).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("last_updated_at"))
    return reasoning.decay(o, F.to_timestamp(F.lit("1998-08-02 00:00:00"))).select("o_orderkey", "decay_factor", "confidence")


@query("WITH a AS (SELECT o_orderkey, greatest(0.0, (epoch_us(TIMESTAMP '1998-08-02 00:00:00') - epoch_us(o_orderdate)) / 86400e6) AS age FROM orders), s AS (SELECT o_orderkey, 1 - exp(-ln(2.0) * age / 90.0) AS st FROM a) SELECT o_orderkey, round(st, 6) AS staleness, round(0.3 * 0.8 + 0.3 * 0.5 + 0.2 * (1 - st) + 0.2 * least((o_orderkey % 9) / 5.0, 1.0), 6) AS relevance FROM s")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit("1998-08-02 00:00:00"))
    s = maths.staleness(maths.age_days(F.col("o_orderdate").cast("timestamp"), now))
    rel = maths.relevance(F.lit(0.8), F.lit(0.5), s, F.col("o_orderkey") % 9)
    return table(spark, d, "orders").select("o_orderkey", F.round(s, 6).alias("staleness"), F.round(rel, 6).alias("relevance"))


_PAIRS = "sp AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), op AS (SELECT s_name AS s, p_name || ' #' || p_partkey AS o, l_suppkey * 1000000 + l_partkey AS k, l_partkey FROM sp JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"


def _opposed(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    sp = table(spark, d, "lineitem").filter(where).select("l_suppkey", "l_partkey").distinct()
    j = sp.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    k = F.col("l_suppkey") * 1000000 + F.col("l_partkey")
    base = j.select(F.col("s_name").alias("subject"), F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("object"), k.alias("k"), "l_partkey")
    a = base.select("subject", F.lit("contains").alias("predicate"), "object", (F.col("k") * 2).alias("seq"))
    return a.union(base.filter("l_partkey % 10 = 0").select("subject", F.lit("excludes"), "object", F.col("k") * 2 + 1))


_SIZES = "v AS (SELECT lower(p_name) AS subject, CAST(p_size AS VARCHAR) AS value, min(p_partkey) AS s FROM part GROUP BY 1, 2), conflict AS (SELECT a.subject, 'has_size' AS predicate, a.value AS value_a, b.value AS value_b FROM v a JOIN v b ON a.subject = b.subject AND a.s < b.s)"


@query(f"WITH {_PAIRS}, {_SIZES} SELECT 'opposing_predicate' AS kind, 'high' AS severity, lower(s) AS subject, 'Opposing predicates ''contains'' and ''excludes'' for (' || lower(s) || ', ' || lower(o) || ').' AS detail FROM op WHERE l_partkey % 10 = 0 UNION ALL SELECT 'value_conflict', 'medium', subject, 'Conflicting values for (' || subject || ', has_size): ' || chr(39) || value_a || chr(39) || ' vs ' || chr(39) || value_b || chr(39) || '.' FROM conflict")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.contradictions(_opposed(spark, d).unionByName(_part_sizes(spark, d)))


@query(f"WITH {_SIZES} SELECT * FROM conflict")
def value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.value_conflicts(_part_sizes(spark, d)).drop("seq_a", "seq_b")


@query("WITH v AS (SELECT lower(p_name) AS subject, p_size::VARCHAR AS value, count(*) AS facts, min(p_partkey) AS first_seq FROM part GROUP BY ALL) SELECT subject, 'has_size' AS predicate, value, facts, first_seq, n AS values FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM v) WHERE n > 1")
def value_classes(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.value_classes(_part_sizes(spark, d))


def _part_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("subject"), F.lit("has_size").alias("predicate"), F.col("p_size").cast("string").alias("object"), F.col("p_partkey").alias("seq"))


@query("WITH f AS (SELECT o_custkey AS subject, 'ordered' AS predicate, o_orderkey AS object, o_orderdate AS s, o_orderdate + INTERVAL 20 DAY AS e, o_orderkey AS seq FROM orders) SELECT a.subject, a.predicate, a.object AS object_a, b.object AS object_b FROM f a JOIN f b ON a.subject = b.subject AND a.seq < b.seq AND a.object != b.object AND a.s < b.e AND b.s < a.e")
def temporal_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _orders_in_conflict(table(spark, d, "orders"))


def _orders_in_conflict(orders: DataFrame) -> DataFrame:
    f = orders.select(F.col("o_custkey").alias("subject"), F.lit("ordered").alias("predicate"), F.col("o_orderkey").alias("object"), F.col("o_orderdate").alias("start"), F.expr("o_orderdate + interval 20 days").alias("end"), F.col("o_orderkey").alias("seq"))
    return reasoning.temporal_conflicts(f)


@query("""WITH refs AS (SELECT n_nationkey AS seq, CASE n_nationkey % 4 WHEN 0 THEN 'citation' WHEN 1 THEN 'bibliography' WHEN 2 THEN 'internal_ref' ELSE 'footnote' END AS type, CASE WHEN n_nationkey % 4 = 0 AND n_nationkey % 8 = 0 THEN 'unknown ' || n_nationkey ELSE n_name END AS text, CASE WHEN n_nationkey % 4 = 1 THEN 'Book ' || n_nationkey ELSE r_name END AS target FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CASE WHEN text LIKE 'unknown%' THEN 'document' ELSE text END AS src, target AS dst, CASE WHEN type = 'citation' THEN 'cites' ELSE 'references' END AS relation_type FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN text LIKE 'unknown%' THEN 'document' ELSE text END, target ORDER BY seq) AS r FROM refs WHERE type IN ('citation', 'internal_ref')) WHERE r = 1""")
def reference_links(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    kind = F.when(k % 4 == 0, "citation").when(k % 4 == 1, "bibliography").when(k % 4 == 2, "internal_ref").otherwise("footnote")
    text = F.when(k % 8 == 0, F.concat(F.lit("unknown "), k.cast("string"))).otherwise(F.col("n_name"))
    refs = j.select(k.alias("seq"), kind.alias("type"), text.alias("text"), F.when(k % 4 == 1, F.concat(F.lit("Book "), k.cast("string"))).otherwise(F.col("r_name")).alias("target"), F.lit("chunk_000").alias("source_chunk_id"))
    nodes = n.select(F.col("n_name").alias("node_id"), k.alias("ord")).union(r.select("r_name", F.col("r_regionkey") + 100))
    aliases = n.select(F.upper("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    return references.link_references(refs, nodes, aliases, substrings=False)[1].select("src", "dst", "relation_type")


# --- retrieval


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS s FROM v q JOIN v ON q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM x) SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.top_k(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), v, 5).withColumn("score", F.round("score", 6))


def _hits(name: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches(q, '{p}')::INT" for p in patterns) + f" AS {name}"


@query(f"""WITH q AS (SELECT conv_id, turn, lower(trim(text)) || CASE turn % 4 WHEN 0 THEN ' who is between' WHEN 1 THEN ' explain the overview' WHEN 2 THEN ' related cause' ELSE '' END AS q FROM conversations),
s AS (SELECT conv_id, turn, q, {_hits("f", fixed.FACTUAL)}, {_hits("r", fixed.RELATIONAL)}, {_hits("e", fixed.EXPLORATORY)} FROM q),
t AS (SELECT conv_id, turn, CASE WHEN q = '' THEN 'exploratory' WHEN greatest(f, r, e) = 0 THEN 'conceptual' WHEN f = greatest(f, r, e) THEN 'factual' WHEN r = greatest(f, r, e) THEN 'relational' ELSE 'exploratory' END AS query_type FROM s)
SELECT *, CASE query_type WHEN 'relational' THEN 2600 WHEN 'exploratory' THEN 1300 ELSE 2000 END AS estimated_token_cost FROM t""")
def query_plan(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 4
    tail = F.when(t == 0, " who is between").when(t == 1, " explain the overview").when(t == 2, " related cause").otherwise("")
    q = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lower(F.trim("text")), tail).alias("query"))
    return retrieval.plan(q).select("conv_id", "turn", "query_type", "estimated_token_cost")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"r0 AS (SELECT a, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS r FROM deg)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT deg.a, 0.15::DOUBLE * p + 0.85::DOUBLE * coalesce(w, 0) AS r FROM deg LEFT JOIN (SELECT u.a, sum(r.r / d.n) AS w FROM u JOIN r{i} r ON r.a = u.b JOIN deg d ON d.a = u.b GROUP BY u.a) x USING (a))")
    return ", ".join(steps)


@query(f"WITH {I.EDGES}, u AS (SELECT src AS a, dst AS b FROM edges WHERE src != dst UNION SELECT dst, src FROM edges WHERE src != dst), seeds AS (SELECT r_name AS s FROM region WHERE r_regionkey < 2), deg AS MATERIALIZED (SELECT a, count(*) AS n, (a IN (SELECT s FROM seeds))::INT / (SELECT count(DISTINCT a) FROM u WHERE a IN (SELECT s FROM seeds))::DOUBLE AS p FROM u GROUP BY a), {_pagerank_sql(20)} SELECT a AS node, round(r / (SELECT max(r) FROM r20), 6) AS score FROM r20")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rounds, as the SQL has; by itself the operator goes on until its scores settle."""
    seeds = table(spark, d, "region").filter("r_regionkey < 2").select(F.col("r_name").alias("node"))
    return retrieval.pagerank(_edges(spark, d), seeds, rounds=20, tolerance=0).withColumn("score", F.round("score", 6))


@query("WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS s FROM v q JOIN v ON q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM x), k AS (SELECT query_id, id, 0.3 * s + 0.7 * CASE WHEN id % 2 = 0 THEN (id % 10) / 10.0 ELSE 0 END AS s FROM r WHERE n <= 20), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM k WHERE s >= 0.25) SELECT query_id, id, round(s, 6) AS score, rank FROM f WHERE rank <= 20")
def entity_retrieval(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    top = retrieval.top_k(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), v, 20).drop("rank")
    ppr = v.filter("id % 2 = 0").select(F.col("id").alias("node"), ((F.col("id") % 10) / 10).alias("score"))
    return retrieval.prune(retrieval.blend_scores(top, ppr), "entity").withColumn("score", F.round("score", 6))


@query("WITH e AS (SELECT o_custkey AS query_id, (o_orderkey % 100) / 100.0 AS s FROM orders), m AS (SELECT query_id, avg(s) AS m FROM e GROUP BY query_id) SELECT c_custkey AS query_id, round(m, 6) AS mean_score, coalesce(m, 0) < 0.6 AS fallback FROM customer LEFT JOIN m ON query_id = c_custkey")
def chunk_fallback(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), ((F.col("o_orderkey") % 100) / 100).alias("score"), "o_orderkey")
    return retrieval.needs_chunks(q, e, order="o_orderkey").withColumn("mean_score", F.round("mean_score", 6))


_BUDGET = "t AS (SELECT conv_id AS query_id, turn AS ord, CASE turn % 3 WHEN 0 THEN 'community_summary' WHEN 1 THEN 'entity_profile' ELSE 'chunk' END AS source_type, text AS content, sum(length(text)) OVER w AS z FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), o AS (SELECT *, z - length(content) AS a, sum((z > 800)::INT) OVER (PARTITION BY query_id ORDER BY ord) AS over FROM t), fit AS (SELECT query_id, ord, source_type, CASE WHEN over = 0 THEN content ELSE substr(content, 1, (800 - a)::INT) || '...' END AS content FROM o WHERE over = 0 OR (over = 1 AND 800 - a > 100))"


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 3
    kind = F.when(t == 0, "community_summary").when(t == 1, "entity_profile").otherwise("chunk")
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), kind.alias("source_type"), F.col("text").alias("content"))
    return retrieval.fit_budget(r, 200)


@query(f"WITH {_BUDGET} SELECT * FROM fit")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d)


@query(f"WITH {_BUDGET}, g AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE source_type = 'community_summary') AS c, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE source_type = 'entity_profile') AS e, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE source_type = 'chunk') AS k, sum(length(content))::BIGINT AS n FROM fit GROUP BY query_id) SELECT query_id, concat_ws(chr(10) || chr(10), '## Document Context' || chr(10) || c, '## Relevant Entities' || chr(10) || e, '## Evidence' || chr(10) || k) AS context, n AS used_chars, n // 4 AS tokens FROM g")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.assemble(_fitted(spark, d))


@query("WITH ask AS (SELECT r_regionkey AS query_id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0), t AS (SELECT 'topic_' || (n_nationkey % 4) AS topic, n_name AS name FROM nation) SELECT DISTINCT query_id, topic FROM ask JOIN t USING (name)")
def corpus_topics(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    q = n.filter("n_nationkey % 2 = 0").groupBy(F.col("n_regionkey").alias("query_id")).agg(F.collect_list("n_name").alias("names"))
    t = n.groupBy(F.concat(F.lit("topic_"), (F.col("n_nationkey") % 4).cast("string")).alias("topic")).agg(F.collect_list("n_name").alias("members"))
    x = spark.createDataFrame([], "src string, dst string, relation_type string, confidence double")
    return retrieval.corpus_context(q, n.select(F.col("n_name").alias("name")), t, x)[1].select("query_id", "topic")


def _ppr_by_query_sql(rounds: int) -> str:
    steps = ["p0 AS MATERIALIZED (SELECT query_id, id AS a, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS r FROM seeds)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT query_id, a, sum(r) AS r FROM (SELECT query_id, u.b AS a, 0.85::DOUBLE * r / n AS r FROM p{i} JOIN u USING (a) JOIN deg USING (a) UNION ALL SELECT query_id, a, 0.15::DOUBLE * r FROM p0) GROUP BY query_id, a)")
    return ", ".join(steps)


_LEVEL = "CASE vec_id % 4 WHEN 0 THEN 'community' WHEN 1 THEN 'entity' WHEN 2 THEN 'relation' ELSE 'chunk' END"
_RANKED = "SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM x WHERE level = '{0}' AND list_contains(levels, '{1}')"


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, {_LEVEL} AS level, 'text of ' || vec_id AS content FROM embeddings),
q AS (SELECT id AS query_id, e AS qe, CASE WHEN id % 200 = 0 THEN ['community', 'entity'] ELSE ['entity', 'chunk', 'corpus'] END AS levels FROM v WHERE id % 100 = 0),
x AS MATERIALIZED (SELECT query_id, levels, id, level, list_cosine_similarity(qe, e) AS s FROM q, v),
u AS MATERIALIZED (SELECT id AS a, id + 1 AS b FROM v UNION SELECT id + 1, id FROM v), deg AS MATERIALIZED (SELECT a, count(*) AS n FROM u GROUP BY a),
found AS MATERIALIZED (SELECT *, 'e' AS kind FROM ({_RANKED.format("entity", "entity")}) WHERE rank <= 20 UNION ALL SELECT query_id, id, s, rank + 20, 'r' FROM ({_RANKED.format("relation", "entity")}) WHERE rank <= 10),
seeds AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM found) WHERE k <= 5 AND s > 0.3),
{_ppr_by_query_sql(80)},
blended AS (SELECT query_id, id, rank, CASE WHEN query_id IN (SELECT query_id FROM p0) THEN 0.3 * s + 0.7 * coalesce(r / (SELECT max(r) FROM p80 t WHERE t.query_id = f.query_id), 0) ELSE s END AS s FROM found f LEFT JOIN (SELECT query_id, a AS id, r FROM p80) USING (query_id, id)),
entity AS (SELECT * FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS ord FROM blended WHERE s >= 0.25) WHERE ord <= 20),
weak AS (SELECT query_id FROM q LEFT JOIN entity USING (query_id) GROUP BY query_id HAVING coalesce(avg(s), 0) < 0.6),
results AS (SELECT query_id, id, rank AS ord, 0 AS l FROM ({_RANKED.format("community", "community")}) WHERE rank <= 5 AND s >= 0.3 UNION ALL SELECT query_id, id, ord, 1 FROM entity UNION ALL SELECT query_id, id, rank, 2 FROM ({_RANKED.format("chunk", "chunk")}) JOIN weak USING (query_id) WHERE rank <= 10 AND s >= 0.2),
g AS (SELECT query_id, sum(length(content))::BIGINT AS n, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE l = 0) AS c, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE l = 1) AS e, string_agg(content, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE l = 2) AS k FROM results JOIN v USING (id) GROUP BY query_id)
SELECT query_id, concat_ws(chr(10) || chr(10), '## Document Context' || chr(10) || c, '## Relevant Entities' || chr(10) || e, '## Evidence' || chr(10) || k) AS context, n AS used_chars, n // 4 AS tokens FROM g""")
def retrieve_context(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    k = F.col("vec_id") % 4
    level = F.when(k == 0, "community").when(k == 1, "entity").when(k == 2, "relation").otherwise("chunk")
    vectors = v.select(F.col("vec_id").alias("id"), level.alias("level"), "embedding", F.concat(F.lit("text of "), F.col("vec_id").cast("string")).alias("content"))
    edges = v.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    queries = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 200 == 0, "explain it").otherwise("how are they related").alias("query"), "embedding")
    return retrieval.retrieve(queries, vectors, edges, search=retrieval.top_k, bound=1e-6)  # exact, as the SQL is


# --- usage


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return tracking.priced(I.calls(spark, d), I.prices(spark))


@query(f"WITH {I.CALLS} SELECT agent, count(*) AS total_calls, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens, round(avg(latency_ms), 6) AS avg_latency_ms, max(latency_ms) AS max_latency_ms, sum(retry_count)::BIGINT AS retry_count, count(*) FILTER (WHERE status = 'failed') AS failure_count, round(sum(cost_usd), 9) AS cost_usd, round(sum(input_tokens + output_tokens) / 50000.0 * 100, 6) AS budget_pct FROM priced GROUP BY agent")
def agent_stats(spark: SparkSession, d: str) -> DataFrame:
    a = tracking.by_agent(_priced(spark, d), 50000).drop("first_at", "last_at", "total_cache_read_tokens", "total_cache_write_tokens")
    return a.withColumns({"avg_latency_ms": F.round("avg_latency_ms", 6), "cost_usd": F.round("cost_usd", 9), "budget_pct": F.round("budget_pct", 6)})


_SESSION = f"{I.CALLS}, s AS (SELECT document_id, sum(calls)::BIGINT AS total_calls, sum(t)::BIGINT AS total_tokens, sum(cost) AS cost_usd, count(*) AS agents, (epoch_us(max(z)) - epoch_us(min(a))) / 1e6 AS duration_seconds, max(z) AS z, list_sort(list(agent) FILTER (WHERE t > 100)) AS over, list_sort(list(agent) FILTER (WHERE failed > 0)) AS bad FROM agents GROUP BY document_id)"


@query(f"WITH {_SESSION} SELECT document_id, total_calls, total_tokens, round(cost_usd, 9) AS cost_usd, agents, round(duration_seconds, 3) AS duration_seconds, coalesce(array_to_string(over, ','), '') AS steps_degraded, coalesce(array_to_string(bad, ','), '') AS steps_failed, round(total_tokens / (agents * 100.0) * 100, 6) AS budget_usage_pct FROM s")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    s = tracking.sessions(_priced(spark, d), 100)
    join = lambda c: F.array_join(c, ",").alias(c)
    return s.select("document_id", "total_calls", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"), "agents", F.round("duration_seconds", 3).alias("duration_seconds"), join("steps_degraded"), join("steps_failed"), F.round("budget_usage_pct", 6).alias("budget_usage_pct"))


@query(f"WITH {_SESSION} SELECT count(*) AS documents, sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost_usd), 9) AS cost_usd, round(avg(total_tokens), 6) AS avg_tokens, round(avg(cost_usd), 6) AS avg_cost, round(avg(duration_seconds), 3) AS avg_duration FROM s")
def global_stats(spark: SparkSession, d: str) -> DataFrame:
    t = tracking.totals(tracking.sessions(_priced(spark, d)))
    return t.withColumns({"cost_usd": F.round("cost_usd", 9), "avg_tokens": F.round("avg_tokens", 6), "avg_cost": F.round("avg_cost", 6), "avg_duration": F.round("avg_duration", 3)})


@query(f"WITH {_SESSION} SELECT 'type_' || (CAST(substr(document_id, 5) AS BIGINT) % 3) AS document_type, count(*) AS documents, round(avg(total_tokens), 6) AS avg_tokens, round(avg(CAST(substr(document_id, 5) AS BIGINT) % 7), 6) AS avg_chunks FROM s GROUP BY 1")
def stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    s = tracking.sessions(_priced(spark, d))
    n = F.substring("document_id", 5, 20).cast("long")
    types = s.select("document_id", F.concat(F.lit("type_"), (n % 3).cast("string")).alias("document_type"), (n % 7).alias("chunks"))
    return tracking.by_type(s, types).select("document_type", "documents", F.round("avg_tokens", 6).alias("avg_tokens"), F.round("avg_chunks", 6).alias("avg_chunks"))


@query(f"WITH {I.CALLS} SELECT model, count(*) AS total_calls, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, round(sum(cost_usd), 9) AS total_cost_usd FROM priced GROUP BY model")
def stats_by_model(spark: SparkSession, d: str) -> DataFrame:
    return tracking.by_model(_priced(spark, d)).withColumn("total_cost_usd", F.round("total_cost_usd", 9))


@query(f"WITH {_SESSION} SELECT strftime(z, '%Y-%m-%d') AS date, count(*) AS documents_processed, sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost_usd), 9) AS total_cost_usd FROM s GROUP BY 1")
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return tracking.by_day(tracking.sessions(_priced(spark, d))).withColumn("total_cost_usd", F.round("total_cost_usd", 9))


@query(f"WITH {I.CALLS} SELECT agent, count(*) AS total_calls, sum(input_tokens + output_tokens)::BIGINT AS total_tokens, round(sum(input_tokens + output_tokens) / count(*)::DOUBLE, 6) AS avg_tokens_per_call, round(count(*) FILTER (WHERE status = 'failed') / count(*)::DOUBLE, 6) AS failure_rate, round(sum(input_tokens + output_tokens) / (SELECT sum(input_tokens + output_tokens) FROM calls)::DOUBLE * 100, 6) AS pct_of_total_tokens FROM calls GROUP BY agent")
def agent_shares(spark: SparkSession, d: str) -> DataFrame:
    a = tracking.agents_overall(_priced(spark, d)).drop("avg_latency_ms")
    return a.withColumns({c: F.round(c, 6) for c in ("avg_tokens_per_call", "failure_rate", "pct_of_total_tokens")})


_BUDGETS = {"image_analyzer": "m * 1000", "reference_extractor": "least(t, 4096)", "decontextualizer": "n * 4096", "summarizer": "n * 4096", "densifier": "20480", "concept_extractor": "n * 4096", "entity_normalizer": "greatest(1, n // 5) * 4096", "relation_normalizer": "greatest(1, n // 10) * 4096", "community_summarizer": "greatest(1, n // 3) * 4096", "profile_generator": "greatest(1, n // 3) * 8192", "synthesizer": "8192", "critic": "0"}


@query("WITH x AS (SELECT doc_id AS document_id, length(text) // 4 AS t, length(text) // 2000 + 1 AS n, doc_id % 4 AS m FROM documents) " + " UNION ALL ".join(f"SELECT document_id, '{a}' AS agent, ({e})::BIGINT AS allocated FROM x" for a, e in _BUDGETS.items()))
def budget_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.col("doc_id").alias("document_id"), X.tokens(F.col("text")).alias("text_tokens"), (F.floor(F.length("text") / 2000) + 1).alias("n_chunks"), (F.col("doc_id") % 4).alias("n_images"))
    return tracking.estimate_budget(docs)


@query(f"WITH {I.CALLS} SELECT document_id, agent, 60::BIGINT AS allocated, sum(input_tokens + output_tokens)::BIGINT AS consumed, sum(input_tokens + output_tokens) <= 60 AS within FROM calls GROUP BY 1, 2")
def budget_check(spark: SparkSession, d: str) -> DataFrame:
    c = I.calls(spark, d)
    return tracking.over_budget(c.select("document_id", "agent").distinct().withColumn("allocated", F.lit(60).cast("long")), c)


@query("SELECT event_type AS key, sum(value * 2) AS total, (count(*) * 2) AS n, avg(value) AS mean FROM (SELECT event_type, round(value) AS value FROM events) GROUP BY event_type")
def mean_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.sum(F.round("value")).alias("total"), F.count("*").alias("n"))
    return tracking.merge_mean(e, e, "key").withColumns({"total": F.col("total"), "mean": F.col("mean")})


# --- models, plans, scalars


@query("SELECT doc_id, 'Rewrite the passage so that it stands alone. Context before it:' || chr(10) || source || chr(10) || chr(10) || 'Passage:' || chr(10) || text AS prompt FROM documents")
def prompt_rendering(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", models.render(models.PROMPTS["decontextualizer"], context=F.col("source"), content=F.col("text")).alias("prompt"))


@query("SELECT c_custkey, s AS seq, c_name AS subject, CASE s WHEN 0 THEN 'is_a' ELSE 'has' END AS predicate, CASE s WHEN 0 THEN 'customer' ELSE c_mktsegment END AS object, CASE s WHEN 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM customer, range(2) r(s) WHERE c_custkey % 5 != 0")
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('[{"subject":"'), F.col("c_name"), F.lit('","predicate":"is_a","object":"customer","confidence":0.9},{"subject":"'), F.col("c_name"), F.lit('","predicate":"has","object":"'), F.col("c_mktsegment"), F.lit('"},{"subject":"x"}]'))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select("c_custkey", F.when(k % 5 == 0, "no json").when(k % 2 == 0, fenced).otherwise(body).alias("answer"))
    return models.parse_facts(a).drop("context_sentence")


@query("SELECT * FROM (VALUES (0, 'concept_extractor'), (0, 'reference_extractor'), (0, 'summarizer'), (1, 'community_summarizer'), (1, 'densifier'), (1, 'profile_generator'), (2, 'synthesizer'), (3, 'critic')) t(level, agent)")
def agent_levels(spark: SparkSession, d: str) -> DataFrame:
    depends = {"concept_extractor": [], "reference_extractor": [], "summarizer": [], "densifier": ["summarizer"], "community_summarizer": ["concept_extractor"], "profile_generator": ["concept_extractor"], "synthesizer": ["densifier", "community_summarizer", "profile_generator"], "critic": ["synthesizer"]}
    return spark.createDataFrame([(i, a) for i, level in enumerate(levels(depends)) for a in level], "level int, agent string")


@query("SELECT n_name AS step, CASE WHEN n_nationkey < 5 THEN 'removed' WHEN n_nationkey >= 20 THEN 'added' WHEN n_nationkey % 2 = 0 THEN 'same' ELSE 'changed' END AS change FROM nation")
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a = n.filter("n_nationkey < 20").select(F.col("n_name").alias("step"), F.lit("0").alias("digest"))
    return diff_runs(a, n.filter("n_nationkey >= 5").select(F.col("n_name").alias("step"), (F.col("n_nationkey") % 2).cast("string").alias("digest")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'md' END AS format, (p_size * 1048576)::BIGINT AS bytes, translate(p_name, '/ ', '__') AS graph_key, lower(replace(p_name, ' ', '_')) AS slug, pow(2.0, p_partkey % 5) AS wait FROM part")
def scalar_helpers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, ".PDF").when(k == 1, ".jpeg").when(k == 2, ".md").otherwise(".exe"))
    return table(spark, d, "part").select("p_partkey", X.format_of(name).alias("format"), X.size_bytes(F.concat(F.col("p_size").cast("string"), F.lit("MB"))).alias("bytes"), X.graph_key(F.col("p_name")).alias("graph_key"), X.slug(F.col("p_name")).alias("slug"), X.backoff(F.col("p_partkey") % 5).alias("wait"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'timeout' WHEN 2 THEN 'server_error' WHEN 3 THEN 'parse_error' WHEN 4 THEN 'token_limit' ELSE 'unknown' END AS kind FROM events")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    messages = ["HTTP 429", "timed out: timeout", "bad gateway 502", "invalid JSON", "token limit exceeded", "other"]
    m = F.element_at(F.array(*map(F.lit, messages)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.error_class(F.lit("Error"), m).alias("kind"))
