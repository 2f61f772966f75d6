"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.conversation_trie import prefix_trie
from factloom.llm.decontaminate import find_leaks
from factloom.llm.divergence import divergence
from factloom.llm.exact_dedup import exact_dedup
from factloom.llm.html_text import extract_text
from factloom.llm.minhash import near_dedup
from factloom.llm.phrase_dedup import repeated_bytes
from factloom.llm.pieces import round_trip
from factloom.llm.quality import quality
from factloom.llm.toxicity import toxicity
from factloom.llm.url_filter import url_filter
from factloom.llm.wavelet import token_files
from factloom.llm.window_index import substring_dedup
from factloom.shared import table

#: (verdict, host, path) of the url filter query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of op7 where nine in ten pages redirect to the page of the next id, and some have no url or an empty one."""
    pages = table(spark, sf_dir, "pages")
    pages = pages.withColumn("url", F.when(F.col("page_id") % 50 == 1, None).when(F.col("page_id") % 50 == 2, "").otherwise(F.col("url")))
    to = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"))
    redirects = pages.filter("page_id % 10 != 9").join(to, "page_id").select(F.col("url").alias("src"), "dst")
    return url_filter(pages, URL_RULES, redirects)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("max_overlap")  # of aligned passages only, so SQL over all alignments has other values for clean documents


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_substring_dedup, op3_quality_classifier, op4_suffix_array_dedup, op5_toxicity, op6_sentencepiece, op7_url_filter, url_redirects, op8_decontamination, op9_exact_dedup, op10_html_text, op11_conversation_trie, op12_source_divergence, op13_token_files, pipeline)}

_HOST = "CASE WHEN strpos(u, '://') > 0 THEN translate(regexp_extract(substr(u, strpos(u, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN strpos(u, '://') > 0 THEN regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_FIT = " UNION ALL ".join(
    f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS verdict FROM parsed WHERE (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for v, h, p in URL_RULES
)
_KEY = f"""CASE WHEN host = '' THEN NULL ELSE lower(regexp_extract(u, '^([^:/?#]+)://', 1)) || '://' || regexp_replace(host, CASE WHEN u ILIKE 'https:%' THEN ':443$' WHEN u ILIKE 'http:%' THEN ':80$' ELSE '$^' END, '')
    || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(substr(u, strpos(u, '://') + 3), '^[^?#]*([?][^#]*)', 1) END"""
_WORD = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        walk AS (SELECT a AS node, a AS seen FROM near UNION SELECT walk.node, near.b FROM walk JOIN near ON near.a = walk.seen),
        comp AS (SELECT node, min(seen) AS c FROM walk GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id""",
    "op2_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w),
        win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s+49], ' ')) AS h FROM starts),
        first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, s + k AS j FROM win JOIN first USING (h), range(50) r(k) WHERE m < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_suffix_array_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        starts AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS s FROM b),
        win AS (SELECT doc_id, s, md5(substr(x, s * 2 + 1, 400)) AS h FROM starts),
        twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS r FROM win SEMI JOIN twice USING (h)),
        runs AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z FROM hit GROUP BY doc_id, r),
        marked AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM runs),
        grouped AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM marked),
        spans AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM grouped GROUP BY doc_id, g),
        gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM spans UNION ALL SELECT doc_id, max(z), 1000000000 FROM spans GROUP BY doc_id),
        cut AS (SELECT doc_id, string_agg(substr(x, p * 2 + 1, (q - p) * 2), '' ORDER BY p) AS k FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
        n AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
        FROM b LEFT JOIN n USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS w, generate_subscripts(regexp_extract_all({_LOWER}, '{_WORD}'), 1) AS p FROM documents),
        i0 AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark),
        i AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS q, least(13, len(ws)) AS n FROM i0 WHERE len(ws) >= 5),
        same AS (SELECT doc_id, item_id, p - q AS shift, q, n FROM d JOIN i USING (w)),
        best AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM same),
        leak AS (SELECT DISTINCT doc_id, item_id FROM best WHERE c >= CASE WHEN n < 9 THEN n ELSE 0.8 * n END)
        SELECT doc_id, max(item_id) IS NOT NULL AS contaminated, list_sort(coalesce(list(item_id) FILTER (WHERE item_id IS NOT NULL), [])) AS item_ids, count(item_id) AS n_items FROM documents LEFT JOIN leak USING (doc_id) GROUP BY doc_id""",
    "op9_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
        h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    # crc32 of a decimal id: eight shifts a byte
    "op11_conversation_trie": f"""
        WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT c, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::UBIGINT)),
            lambda x, b: list_reduce(list_prepend(xor(x, b), list_transform(range(8), lambda k: k::UBIGINT)), lambda y, k: xor(y >> 1, 3988292384::UBIGINT * (y & 1))))) % 4 AS h FROM own),
        full_turns AS (SELECT ids.c, i, role, text FROM ids JOIN own ON own.c = ids.c - ids.c % 20 AND i <= h
            UNION ALL SELECT ids.c, 1000000000 + i, role, text FROM ids JOIN own USING (c) WHERE i > h),
        seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, role, text FROM full_turns),
        keyed AS (SELECT c, d, len(regexp_extract_all(text, '{_WORD}')) AS w, list(md5(role) || md5(text)) OVER (PARTITION BY c ORDER BY d) AS k FROM seq
            UNION ALL SELECT c, 0, 0, [] FROM ids),
        size AS (SELECT c, max(d) AS n FROM keyed GROUP BY c),
        node AS (SELECT d AS depth, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
            lower(sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), ''))) AS ends_sha256 FROM keyed JOIN size USING (c) GROUP BY d, k),
        kids AS (SELECT k[:len(k) - 1] AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
        full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
        under AS (SELECT k[:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM full_node, unnest(range(0, len(k) + 1)) AS r(a) GROUP BY ALL)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
        FROM full_node f JOIN under USING (k) LEFT JOIN node p ON p.depth = f.depth - 1 AND p.k = f.k[:len(f.k) - 1]""",
    "op12_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
        k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, sum(n) AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p
              FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(t) + 2 * any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS t FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "url_redirects": f"""
        WITH RECURSIVE raw AS (SELECT page_id, CASE page_id % 50 WHEN 1 THEN '' WHEN 2 THEN '' ELSE coalesce(url, '') END AS u FROM pages),
        parsed AS (SELECT page_id, u, {_HOST} AS host, {_PATH} AS path FROM raw),
        fit AS ({_FIT}),
        best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM fit GROUP BY page_id),
        k AS (SELECT page_id, {_KEY} AS key FROM parsed),
        e AS (SELECT a.key AS a, b.key AS b FROM k a JOIN k b ON b.page_id = a.page_id + 1 WHERE a.page_id % 10 <> 9 AND a.key IS NOT NULL AND b.key IS NOT NULL),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        walk AS (SELECT a AS n, a AS m FROM s UNION SELECT walk.n, s.b FROM walk JOIN s ON s.a = walk.m),
        comp AS (SELECT n, min(m) AS c FROM walk GROUP BY n),
        named AS (SELECT page_id, coalesce(c, key) AS c FROM k LEFT JOIN comp ON n = key),
        v AS (SELECT c, bool_or(verdict = 'allow') AS allowed FROM named JOIN best USING (page_id) GROUP BY c)
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict,
               CASE WHEN b.rule IS NOT NULL THEN 'rule' WHEN allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS via
        FROM parsed p JOIN named USING (page_id) LEFT JOIN best b USING (page_id) LEFT JOIN v ON v.c = named.c""",
    # without links between pages the method's own verdict is the default
    "op7_url_filter": f"""
        WITH raw AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
        parsed AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM raw),
        fit AS ({_FIT}),
        best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM fit GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict,
               CASE WHEN b.rule IS NULL THEN 'default' ELSE 'rule' END AS via
        FROM parsed p LEFT JOIN best b USING (page_id)""",
}
