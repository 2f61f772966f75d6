"""Inputs of the registered queries, derived from the star schema, documents and events; and the same as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.shared import spread, table


def raw_facts(spark: SparkSession, d: str) -> DataFrame:
    """Four facts of each customer: nation, the nation's region, market segment, balance."""
    own = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"), each=1 << 19)  # four facts a row are grouped by sorting them
    c = own.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    by3 = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    rows = [
        ("c_name", by3("located_in", "Located in", "situé dans"), F.col("n_name")),
        ("n_name", by3("part_of", "belongs to", "fait partie de"), F.col("r_name")),
        ("c_name", F.when(k % 2 == 0, "buys in").otherwise(" Buys In "), F.col("c_mktsegment")),
        ("c_name", F.lit("has balance"), F.floor("c_acctbal").cast("string")),
    ]
    facts = F.array(*[F.struct((k * 4 + i).alias("seq"), F.col(s).alias("subject"), p.alias("predicate"), o.alias("object")) for i, (s, p, o) in enumerate(rows)])
    out = c.select(F.explode(facts).alias("f"), F.format_string("chunk_%03d", (k % 50).cast("int")).alias("source_chunk_id"), (F.lit(0.5) + (k % 50) / 100).alias("confidence"))
    return out.select("f.*", "source_chunk_id", "confidence")


def _case(mapping: dict[str, str], value: str, default: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def canonical_sql(value: str) -> str:
    first: dict[str, str] = {}
    for c, _, _, forms in fixed.RELATIONS:
        for f in [*forms, c]:
            first.setdefault(f.lower(), c)
    return _case(first, f"lower(trim({value}))", f"replace(lower(trim({value})), ' ', '_')")


RAW = """c AS (SELECT c_custkey AS k, c_name, n_name, r_name, c_mktsegment, c_acctbal, printf('chunk_%03d', c_custkey % 50) AS source_chunk_id,
  0.5::DOUBLE + (c_custkey % 50) / 100.0::DOUBLE AS confidence
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT k * 4 AS seq, c_name AS subject, CASE k % 3 WHEN 0 THEN 'located_in' WHEN 1 THEN 'Located in' ELSE 'situé dans' END AS predicate, n_name AS object, source_chunk_id, confidence FROM c
  UNION ALL SELECT k * 4 + 1, n_name, CASE k % 3 WHEN 0 THEN 'part_of' WHEN 1 THEN 'belongs to' ELSE 'fait partie de' END, r_name, source_chunk_id, confidence FROM c
  UNION ALL SELECT k * 4 + 2, c_name, CASE k % 2 WHEN 0 THEN 'buys in' ELSE ' Buys In ' END, c_mktsegment, source_chunk_id, confidence FROM c
  UNION ALL SELECT k * 4 + 3, c_name, 'has balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), source_chunk_id, confidence FROM c)"""
CONS = f"""{RAW}, f AS (SELECT seq, trim(subject) AS s, {canonical_sql("predicate")} AS p, trim(object) AS o, trim(predicate) AS form, source_chunk_id, confidence FROM raw),
cons AS (SELECT arg_min(s, seq) AS subject, arg_min(p, seq) AS predicate, arg_min(o, seq) AS object, list_sort(list(DISTINCT source_chunk_id)) AS source_chunk_ids, count(*) AS occurrence_count,
  CASE WHEN count(*) > 1 THEN round(least(1.0::DOUBLE, max(confidence) * (1 + 0.1::DOUBLE * (count(*) - 1))), 4) ELSE max(confidence) END AS confidence,
  list_sort(list(DISTINCT form)) AS original_forms FROM f GROUP BY lower(s), lower(p), lower(o))"""
LITERAL = lambda v: " OR ".join(f"regexp_matches({v}, '{p}')" for p in fixed.LITERALS)
NODES = f"""{CONS}, ends AS (SELECT subject AS node_id, occurrence_count, source_chunk_ids, confidence FROM cons UNION ALL SELECT object, occurrence_count, source_chunk_ids, confidence FROM cons),
nodes AS (SELECT node_id, sum(occurrence_count)::BIGINT AS occurrence_count, list_sort(list_distinct(flatten(list(source_chunk_ids)))) AS source_chunk_ids, max(confidence) AS confidence,
  ({LITERAL("node_id")}) AS is_literal, CASE WHEN {LITERAL("node_id")} THEN 3 ELSE 2 END AS layer FROM ends GROUP BY node_id)"""
EDGES = f"{NODES}, edges AS (SELECT subject AS src, object AS dst, predicate AS relation_type, confidence, occurrence_count FROM cons)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as model calls."""
    e = table(spark, d, "events")
    n = F.floor(F.abs("value")).cast("long")
    return e.select(
        F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("document_id"), F.col("event_type").alias("agent"), F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), n.alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"),
        n.alias("latency_ms"), (F.col("event_id") % 3).alias("retry_count"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


PRICES = [("model_0", 3.0, 15.0, 0.3, 3.75), ("model_1", 0.8, 4.0, 0.08, 1.0), ("model_2", 2.5, 10.0, 0.0, 0.0), ("model_3", 0.15, 0.6, 0.0, 0.0)]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double, cache_read_price double, cache_write_price double")


_P = " UNION ALL ".join(f"SELECT '{m}' AS model, {i}::DOUBLE AS ip, {o}::DOUBLE AS op" for m, i, o, _, _ in PRICES)
CALLS = f"""calls AS (SELECT 'doc_' || user_id AS document_id, event_type AS agent, 'model_' || (user_id % 5) AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
  CAST(floor(abs(value)) AS BIGINT) AS output_tokens, CAST(floor(abs(value)) AS BIGINT) AS latency_ms, event_id % 3 AS retry_count, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, ts AS "timestamp" FROM events),
priced AS (SELECT calls.*, coalesce((input_tokens * ip + output_tokens * op) / 1e6, 0.0)::DOUBLE AS cost_usd FROM calls LEFT JOIN ({_P}) p USING (model)),
agents AS (SELECT document_id, agent, count(*) AS calls, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(input_tokens + output_tokens) AS t, sum(cost_usd) AS cost, count(*) FILTER (WHERE status = 'failed') AS failed, min("timestamp") AS a, max("timestamp") AS z FROM priced GROUP BY document_id, agent)"""


def marked_up(spark: SparkSession, d: str) -> DataFrame:
    """Documents with headings, a footnote and a table added."""
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("# Title "), i, F.lit("\n1.2 Part\nTable of contents\n"))
    tail = F.concat(F.lit("\n## References\n[1] note "), i, F.lit("\n| a | b |\n|---|---|\n| 1 | "), i, F.lit(" |\nAnnex B\n| lone |"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.col("text"), tail).alias("text"))


MARKED = """md AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || '1.2 Part' || chr(10) || 'Table of contents' || chr(10) || text || chr(10) || '## References' || chr(10) || '[1] note ' || doc_id || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || doc_id || ' |' || chr(10) || 'Annex B' || chr(10) || '| lone |' AS text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM md)"""
NORM = lambda t: f"trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
SIMHASH = f"""norm AS (SELECT doc_id, {NORM("text")} AS n FROM documents),
words AS (SELECT doc_id, n, string_split(n, ' ') AS w FROM norm),
sh AS (SELECT doc_id, n, unnest(CASE WHEN len(w) < 3 THEN [n] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS s FROM words),
hashed AS (SELECT doc_id, n, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM sh),
votes AS (SELECT doc_id, n, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM hashed, range(64) r(i) GROUP BY doc_id, n, i),
simhash AS (SELECT doc_id, CASE WHEN n = '' THEN 0::UBIGINT ELSE bit_or(CASE WHEN v >= 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END) END AS sh FROM votes GROUP BY doc_id, n)"""
SEGMENTS = """segs0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS seg, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
segs AS (SELECT doc_id, regexp_replace(seg, '^\\s+|\\s+$', '', 'g') AS seg, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM segs0 WHERE regexp_replace(seg, '^\\s+|\\s+$', '', 'g') != ''),
fold AS (SELECT doc_id, i, seg, 0 AS chunk, length(seg) AS size FROM segs WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, s.seg, CASE WHEN f.size + length(s.seg) > 400 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size + length(s.seg) > 400 THEN length(s.seg) ELSE f.size + length(s.seg) END
  FROM fold f JOIN segs s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
packed AS (SELECT doc_id, chunk AS position, string_agg(seg, chr(10) || chr(10) ORDER BY i) AS content FROM fold GROUP BY doc_id, chunk),
chunks AS (SELECT doc_id, position, content, printf('chunk_%03d', position) AS id, substr(sha256(content), 1, 16) AS fingerprint, length(content) AS char_count,
  len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x != '')) AS word_count, length(content) // 4 AS token_count_est, strlen(content) AS b FROM packed)"""
