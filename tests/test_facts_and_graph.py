import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import chunking, communities, dealt, dedup, entities, facts, graph, models, reasoning, references, retrieval


def _facts(spark, rows):
    return spark.createDataFrame(rows, "seq long, subject string, predicate string, object string, source_chunk_id string, confidence double, context_sentence string")


def test_consolidation_merges_casings_and_boosts(spark):
    f = _facts(spark, [(1, " European Union ", "regulates", "cybersecurity", "c2", 0.8, "s1"), (2, "european union", "Regulates", "Cybersecurity", "c1", 0.9, "s2"), (3, "european union", "governs", "cybersecurity", "c1", 0.5, "s1")])
    r = facts.consolidate(f).collect()
    assert len(r) == 1
    assert (r[0]["subject"], r[0]["predicate"], r[0]["occurrence_count"]) == ("European Union", "regulates", 3)
    assert r[0]["source_chunk_ids"] == ["c1", "c2"] and r[0]["confidence"] == 1.0
    assert r[0]["original_forms"] == ["Regulates", "governs", "regulates"] and r[0]["context_sentences"] == ["s1", "s2"]


def test_consolidation_is_idempotent(spark):
    f = _facts(spark, [(i, f"a{i % 3}", "is a", "thing", "c", 0.5, None) for i in range(9)])
    once = facts.consolidate(f)
    again = facts.consolidate(once.select(F.monotonically_increasing_id().alias("seq"), "subject", "predicate", "object", F.lit("c").alias("source_chunk_id"), "confidence"))
    assert {tuple(r) for r in once.select("subject", "predicate", "object").collect()} == {tuple(r) for r in again.select("subject", "predicate", "object").collect()}


def test_aliases_and_scopes(spark):
    f = spark.createDataFrame([(1, "EU", "requires", "x", "c", 0.5, ("2024", "year")), (2, "EU", "requires", "x", "c", 0.5, ("2024-01-01", "day")), (3, "EU", "requires", "x", "c", 0.5, ("2024-01-02", "day"))], "seq long, subject string, predicate string, object string, source_chunk_id string, confidence double, temporal_scope struct<start:string,granularity:string>")
    r = facts.consolidate(f, spark.createDataFrame([("EU", "European Union")], "alias string, canonical string")).first()
    assert r["subject"] == "European Union" and r["temporal_scope"]["start"] == "2024-01-01"


def test_empty_inputs_give_empty_frames(spark):
    f = _facts(spark, [])
    t = facts.consolidate(f)
    assert t.count() == 0 and graph.build_nodes(t).count() == 0 and graph.collapse(graph.build_edges(t)).count() == 0
    e = graph.build_edges(t)
    assert reasoning.infer_transitive(e).count() == 0 and communities.components(e).count() == 0
    assert retrieval.pagerank(e, spark.createDataFrame([("x",)], "node string")).count() == 0


@pytest.mark.parametrize("value, literal", [("2022", True), ("3.5 GHz", True), ("12 %", True), ("2025-01-15", True), ("500 employees", True), ("", False), ("January 2025", False), ("Berlin", False)])
def test_literals(spark, value, literal):
    assert spark.range(1).select(X.is_literal(F.lit(value))).first()[0] is literal


def test_packing_never_passes_target_unless_one_segment_does(spark):
    texts = ["\n\n".join("x" * n for n in sizes) for sizes in ([10, 20, 30, 5], [100], [1] * 50, [40, 41, 2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    for r in chunking.structural(df, "doc", "text", 42).collect():
        parts = r["content"].split("\n\n")
        assert len(parts) == 1 or sum(map(len, parts)) <= 42
    again = chunking.structural(df, "doc", "text", 42).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "\n\n").alias("t")).collect()
    assert {r["doc"]: r["t"] for r in again} == dict(enumerate(texts))


def test_blocks_stay_whole_and_overlap_carries(spark):
    text = "one\n\n<<<IMAGE_CONTENT id=\"a\">>>\n\nx\n\n<<<END_IMAGE_CONTENT>>>\n\ntwo"
    r = spark.range(1).select(chunking.segments(F.lit(text)).alias("s")).first()["s"]
    assert r == ["one", "<<<IMAGE_CONTENT id=\"a\">>>\n\nx\n\n<<<END_IMAGE_CONTENT>>>", "two"]
    packed = spark.range(1).select(chunking.pack(F.array(*map(F.lit, ["aaaa", "bb", "cccc"])), 6, overlap=2).alias("c")).first()["c"]
    assert packed == ["aaaa\n\nbb", "bb\n\ncccc"]


def test_chunk_validation_finds_broken_links(spark):
    c = spark.createDataFrame([("d", 0, "a", "x" * 60, "f1", None, "b"), ("d", 1, "b", "x" * 60 + "<<<TABLE_CONTENT>>>", "f1", "z", None), ("d", 3, "c", "y", "f2", "b", None)], "document_id string, position int, id string, content string, fingerprint string, preceding_chunk_id string, following_chunk_id string")
    found = {(r["id"], r["issue"]) for r in chunking.validate(c).collect()}
    assert found == {("b", "duplicate fingerprint"), ("b", "unbalanced table block"), ("b", "preceding link"), ("b", "following link"), ("c", "position"), ("c", "too short")}


def test_band_join_equals_brute_force(spark):
    import random

    random.seed(3)
    base = [random.getrandbits(63) for _ in range(60)]
    values = base + [b ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)) for b in base]
    df = spark.createDataFrame(list(enumerate(values)), "id long, simhash long")
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in dedup.near_matches(df, df).collect()}
    assert got == {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(values) for j, b in enumerate(values) if bin(a ^ b).count("1") <= 3}


def test_block_tables_find_three_bits_wherever_they_are(spark):
    """Any three bits, signs included, hot groups of equal hashes and null ones."""
    import itertools
    import random

    rng = random.Random(5)
    base = rng.getrandbits(64) - (1 << 63)
    flip = lambda bits: ((base % (1 << 64)) ^ sum(1 << b for b in bits) ^ (1 << 63)) - (1 << 63)
    near = [flip(bits) for bits in itertools.combinations(range(64), 3)]
    far = [flip(rng.sample(range(64), 4)) for _ in range(2000)]
    right = spark.createDataFrame([(h,) for h in near + far + [None]], "simhash long")
    left = spark.createDataFrame([(base,)] * 50 + [(None,)], "simhash long")
    got = dedup.near_hashes(left, right).collect()
    assert {r["hb"] for r in got} == set(near) and len(got) == len(near) == 41664 and {r["distance"] for r in got} == {3}


def test_lookup_keeps_rows_of_null_texts_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "other words here"), (2, None), (3, ""), (4, "A, b c d")], "doc_id long, text string")
    f = dedup.fingerprints(docs, "doc_id", "text")
    assert sorted(r["doc_id"] for r in f.collect()) == [1, 1, 1, 2, 3, 4] and f.filter("simhash = 0").count() == 2
    cache = f.filter("doc_id in (1, 3)").withColumnRenamed("doc_id", "document_id")
    got = sorted((r["doc_id"], r["hit_level"], r["matched_document"]) for r in dedup.cache_lookup(f, cache, "doc_id").collect())
    assert got == [(1, "exact", 1), (1, "exact", 1), (1, "exact", 1), (2, "exact", 3), (3, "exact", 3), (4, "content", 1)]
    assert dedup.cascade(f, cache, "doc_id").count() == 6


def test_hamming_of_hex(spark):
    d = lambda a, b: spark.range(1).select(X.hamming_hex(F.lit(a), F.lit(b))).first()[0]
    assert (d("", ""), d("", "0f"), d("zz", "0f"), d("00", "0f"), d(None, None)) == (0, 64, 64, 4, 0)


def test_transitive_chain_depth_and_confidence(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "part_of", 0.9) for i in range(9)], "src string, dst string, relation_type string, confidence double")
    got = {(r["src"], r["dst"]): r["confidence"] for r in reasoning.infer_transitive(e, 3).collect()}
    assert got["n0", "n2"] == round(0.9 * 0.9 * 0.7, 4) and ("n0", "n4") in got and ("n0", "n5") not in got
    assert ("n0", "n1") not in got


@pytest.mark.parametrize("cell", [3, 2048])
def test_hot_keys_are_dealt(spark, cell):
    """A third of all rows under one key, a null key, keys on one side only: the same rows as a plain join, each pair once."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}" if i % 3 == 1 else None, i) for i in range(90)]
    left, right = spark.createDataFrame(rows, "k string, x int"), spark.createDataFrame([*rows[:40], ("alone", 1)], "k string, y int")
    got = sorted(map(tuple, dealt.meet(left, right, ["k"], cell).select("k", "x", "y").collect()))
    assert got == sorted((k, x, y) for k, x in rows for m, y in rows[:40] if k is not None and k == m)
    got = sorted(map(tuple, dealt.pairs(left, ["k"], "x", cell).select("k", "x_a", "x_b").collect()))
    assert got == sorted((k, x, y) for k, x in rows for m, y in rows if k is not None and k == m and x < y)
    assert dealt.meet(left.limit(0), right, ["k"], cell).count() == dealt.pairs(left.limit(0), ["k"], "x", cell).count() == 0


def test_periods_of_any_length_meet_once(spark):
    """Points in time, periods around all others, reversed and missing ends, equal starts: as every pair compared."""
    import random

    rng = random.Random(2)
    rows = []
    for i in range(160):
        a = rng.randint(0, 10**6)
        rows.append(("s" if i % 3 else f"t{i % 5}", "p", f"o{i % 9}", a, a + rng.choice([0, 1, 60, 3600, 10**5, 10**6, -50]), i))
    rows += [("s", "p", "all", -(10**8), 10**9, 900), ("s", "p", "all too", -(10**8), 10**9, 901), ("s", "q", "all", 0, 10**9, 902), ("s", "p", "none", None, 5, 903), ("s", "p", "none", 5, None, 904), (None, "p", "x", 0, 9, 905)]
    facts = spark.createDataFrame(rows, "subject string, predicate string, object string, start long, end long, seq long").withColumns({c: F.timestamp_seconds(c) for c in ("start", "end")})
    known = [r for r in rows if None not in r]
    want = sorted((a[0], a[1], a[2], b[2]) for a in known for b in known if a[:2] == b[:2] and a[5] < b[5] and a[2] != b[2] and a[3] < b[4] and b[3] < a[4])
    assert sorted(map(tuple, reasoning.temporal_conflicts(facts).collect())) == want and len(want) > 800


def test_push_stays_within_its_bound_and_its_neighbourhood(spark):
    import numpy as np

    n, bound = 400, 1e-3
    pairs = [(i, (i * 7 + k * k + 1) % n) for i in range(n) for k in range(3)] + [(0, i) for i in range(1, n, 2)]  # a hub
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    seeds = spark.createDataFrame([(q, str(s)) for q in range(4) for s in (q * 90, q * 90 + 5)] + [(9, "unknown")], "query_id int, node string")
    got = retrieval.query_pagerank(edges, seeds, bound=bound).collect()
    m = np.zeros((n, n))
    for a, b in pairs:
        if a != b:
            m[a, b] = m[b, a] = 1
    degree = m.sum(1)
    for q in range(4):
        p = np.zeros(n)
        p[[q * 90, q * 90 + 5]] = 0.5
        exact = np.linalg.solve(np.eye(n) - 0.85 * (m / degree), 0.15 * p)
        mine = np.zeros(n)
        for r in got:
            if r["query_id"] == q:
                mine[int(r["node"])] = r["score"]
        # scores come divided by the largest; the residual bound is on undivided ones
        mine *= exact.max()
        assert (np.abs(exact - mine) <= bound * degree + bound * degree[exact.argmax()] * mine / exact.max() + 1e-9).all()
        assert 0 < (mine > 0).sum() < n
    assert {r["query_id"] for r in got} == {0, 1, 2, 3}
    far = edges.unionByName(spark.createDataFrame([(f"x{i}", f"x{i + 1}") for i in range(3000)], "src string, dst string"))
    assert retrieval.query_pagerank(far, seeds, bound=bound).count() == len(got)  # rows don't grow with the graph


def test_value_classes_say_what_the_pairs_say(spark):
    rows = [("A", "has", "1", 1), ("a", "Has", " 1 ", 2), ("a", "has", "2", 3), ("a", "has", "3", 4), ("b", "has", "1", 5), ("c", "has", "x y z not a literal value at all", 6)]
    f = spark.createDataFrame(rows, "subject string, predicate string, object string, seq long")
    assert sorted(map(tuple, reasoning.value_classes(f).collect())) == [("a", "has", "1", 2, 1, 3), ("a", "has", "2", 1, 3, 3), ("a", "has", "3", 1, 4, 3)]
    assert reasoning.value_conflicts(f).count() == 3


def test_inference_skips_known_inverses(spark):
    e = spark.createDataFrame([("a", "b", "part_of", 0.8), ("b", "a", "contains", 0.5), ("x", "y", "precedes", 1.0)], "src string, dst string, relation_type string, confidence double")
    assert [(r["src"], r["dst"], r["relation_type"], r["confidence"]) for r in reasoning.infer_inverse(e).collect()] == [("y", "x", "follows", 0.7)]


def test_decay_floor_and_missing_time(spark):
    rows = spark.createDataFrame([("old", 1.0, "2000-01-01 00:00:00"), ("new", 0.8, "2024-01-01 00:00:00"), ("none", 0.3, None)], "id string, confidence double, t string").withColumn("last_updated_at", F.to_timestamp("t"))
    got = {r["id"]: r["confidence"] for r in reasoning.decay(rows, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).collect()}
    assert got == {"old": 0.05, "new": 0.8, "none": 0.3}


def test_pagerank_prefers_the_seeds_side(spark):
    e = spark.createDataFrame([("0", "1"), ("1", "2"), ("2", "3"), ("3", "4"), ("8", "9")], "src string, dst string")
    got = {r["node"]: r["score"] for r in retrieval.pagerank(e, spark.createDataFrame([("0",), ("none",)], "node string"), rounds=40).collect()}
    assert max(got.values()) == 1.0 and got["0"] > got["4"] and got["8"] < 0.01
    assert retrieval.pagerank(e, spark.createDataFrame([("none",)], "node string")).count() == 0


def test_link_order_name_alias_incoming(spark):
    s = "canonical_name string, aliases array<string>"
    ex = spark.createDataFrame([("European Union", ["EU"]), ("NATO", [])], s)
    inc = spark.createDataFrame([("european union", []), ("eu", []), ("Alliance", ["x", "nato"]), ("Mars", [])], s)
    got = {r["canonical_name"]: (r["target"], r["how"]) for r in entities.link_by_name(ex, inc).collect()}
    assert got == {"european union": ("European Union", "name"), "eu": ("European Union", "alias"), "Alliance": ("NATO", "incoming alias"), "Mars": (None, None)}


def test_leader_clusters_are_not_transitive(spark):
    import math

    v = [[math.cos(a), math.sin(a)] for a in (0.0, 0.5, 1.0)]  # neighbours are alike, the ends aren't
    df = spark.createDataFrame([(1, n, e) for n, e in zip("abc", v, strict=True)], "document_id int, name string, embedding array<double>")
    got = {r["name"]: r["leader"] for r in entities.leader_clusters(df, 0.85).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_nearest_in_blocks_equals_one_block(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").filter("id < 120")
    one = {tuple(r)[:2] for r in entities.nearest(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), 0.1).collect()}
    assert one == {tuple(r)[:2] for r in entities.nearest(v.filter("id % 2 = 1"), v.filter("id % 2 = 0"), 0.1, small=16).collect()}


def test_references_by_substring_and_document(spark):
    nodes = spark.createDataFrame([("European Union", 0), ("Union", 1)], "node_id string, ord int")
    refs = spark.createDataFrame([(1, "citation", "somewhere", "the union", "c1"), (2, "bibliography", "A. Author. Title", None, "c1"), (3, "footnote", "x", "y", "c")], "seq int, type string, text string, target string, source_chunk_id string")
    bib, edges = references.link_references(refs, nodes, spark.createDataFrame([], "alias string, canonical string"))
    assert [r["node_id"] for r in bib.collect()] == ["A. Author. Title"]
    e = edges.first()
    assert (e["src"], e["dst"], e["relation_type"], e["confidence"]) == ("document", "Union", "cites", 0.8)


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "src long, dst long")
    got = communities.components(e).collect()
    assert {r["node"]: r["component"] for r in got} == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_budget_stops_at_the_first_row_that_does_not_fit(spark):
    rows = spark.createDataFrame([(1, i, "chunk", "x" * n) for i, n in enumerate([300, 300, 350, 10])], "query_id int, ord int, source_type string, content string")
    got = [(r["ord"], len(r["content"])) for r in retrieval.fit_budget(rows, 200).orderBy("ord").collect()]
    assert got == [(0, 300), (1, 300), (2, 203)]


def test_names_are_matched_inside_each_other(spark):
    """Every containment, in both directions, without regard to case, of texts of any length; the first node wins."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abeU ") for _ in range(rng.randint(1, 7))).strip() or "q"
    texts = {"EU", "a", "union ion", "zzz", "", *(word() for _ in range(40))}
    names = ["EU Commission", "ion", "Union of ions", *dict.fromkeys(word() + rng.choice(["", "x"]) for _ in range(25))]
    names = list(dict.fromkeys(names))
    rng.shuffle(names)
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node_id string, ord int")
    got = {r["text"]: r["node_id"] for r in references.match_nodes(spark.createDataFrame([(t,) for t in texts], "text string"), nodes, spark.createDataFrame([("zzz", "ion"), ("ZZZ2", "gone")], "alias string, canonical string")).collect()}
    inside = lambda t, n: t and (t.lower() in n.lower() or n.lower() in t.lower())
    want = {t: t if t in names else "ion" if t == "zzz" else next((n for n in names if inside(t, n)), None) for t in texts}
    assert got == want


def test_retrieval_of_empty_levels_and_of_each_query_by_itself(spark):

    v = [(f"c{i}", "entity", [1.0 if j == i % 4 else 0.1 * (i % 3) for j in range(4)], f"about c{i}") for i in range(8)] + [(f"r{i}", "relation", [0.5, 0.5, 0.1 * i, 0.0], f"relation {i}") for i in range(3)]
    vectors = spark.createDataFrame(v, "id string, level string, embedding array<double>, content string")
    edges = spark.createDataFrame([(f"c{i}", f"c{(i * 3 + 1) % 8}") for i in range(8)], "src string, dst string")
    asked = [(0, "how are they related", [1.0, 0.2, 0.0, 0.0]), (1, "how are they linked", [0.0, 0.1, 1.0, 0.3]), (2, "link between them", [0.0, 0.0, 0.0, 0.0])]
    q = spark.createDataFrame(asked, "query_id int, query string, embedding array<double>")
    both = {r["query_id"]: r["context"] for r in retrieval.retrieve(q, vectors, edges, search=retrieval.top_k).collect()}  # no query asks for communities, no chunk is there
    for i in (0, 1):
        assert {r["query_id"]: r["context"] for r in retrieval.retrieve(q.filter(F.col("query_id") == i), vectors, edges, search=retrieval.top_k).collect()} == {i: both[i]}
    assert "about c0" in both[0] and 2 not in both
    none = retrieval.retrieve(q.limit(0), vectors, edges)
    assert none.count() == 0 and retrieval.retrieve(q, vectors.limit(0), edges).count() == 0
    assert entities.nearest(vectors.select("id", "embedding"), vectors.select("id", "embedding").limit(0), 0.5).count() == 0
    assert retrieval.top_k(vectors.limit(0).select(F.col("id").alias("query_id"), "embedding"), vectors, 3).count() == 0


def test_corpus_level_of_a_context(spark):
    c = spark.createDataFrame([("Alpha Works", "organisation", 0.9, 3, "old", ["d1", "d2"]), ("Beta", "place", 0.5, 1, None, ["d2"]), ("Gamma", "place", 0.4, 1, "", ["d9"])], "name string, entity_type string, confidence double, corroboration int, attributes string, documents array<string>")
    t = spark.createDataFrame([("topic", ["Beta", "Delta"]), ("other", ["Gamma"])], "topic string, members array<string>")
    x = spark.createDataFrame([("Alpha Works", "Beta", "employs", 0.75), ("Gamma", "Delta", "is_a", 0.5)], "src string, dst string, relation_type string, confidence double")
    q = spark.createDataFrame([(1, "how is WORKS related", ["Beta"]), (2, "nothing", [])], "query_id int, query string, names array<string>")
    nodes, topics, edges = retrieval.corpus_context(q, c, t, x)
    assert [r["name"] for r in nodes.orderBy("ord").collect()] == ["Beta", "Alpha Works"]
    text = {r["query_id"]: r["text"] for r in retrieval.corpus_block(nodes, topics, edges).collect()}
    assert text == {1: "Canonical entities from 2 documents:\n  - Beta (place, corroboration=1)\n  - Alpha Works (organisation, corroboration=3) \u2014 old\nTaxonomy categories:\n  - topic: Beta, Delta\nCross-document relations:\n  - Alpha Works \u2014[employs]\u2192 Beta (conf=0.75)"}
    assert {(r["id"], r["content"]) for r in retrieval.corpus_results(nodes).collect()} == {("Beta", "Beta (place)"), ("Alpha Works", "Alpha Works (organisation) \u2014 old")}
    vectors = spark.createDataFrame([("Beta", "entity", [1.0, 0.0], "about beta")], "id string, level string, embedding array<double>, content string")
    asked = spark.createDataFrame([(1, "how are they related", [1.0, 0.0])], "query_id int, query string, embedding array<double>")
    corpus = {"cnodes": c, "tnodes": t, "xedges": x, "contradictions": spark.createDataFrame([("beta", "medium", "b"), ("Beta", "high", "z"), ("beta", "medium", "b"), ("Gamma", "high", "not asked"), (None, "high", "n"), ("beta", None, "c" * 20_000)], "subject string, severity string, text string")}
    out = retrieval.retrieve(asked, vectors, None, corpus).first()
    assert out["context"].split("\n\n")[0].startswith("## Cross-Document Knowledge\nCanonical entities from 1 documents:\n  - Beta") and out["context"].endswith("## Relevant Entities\nabout beta\n\n## Contradictions\n- z\n- b")
    tight = retrieval.retrieve(asked, vectors, None, corpus, tokens=5).first()
    assert tight["context"] == "## Relevant Entities\nabout beta\n\n## Contradictions\n- z\n- b"


def test_agents_context(spark):
    state = spark.createDataFrame([("d1", "dense " * 200, "refine", ["t1", "t2"], [("b", "a"), ("a", "c")]), ("d2", "", "", [], [])], "document_id string, dense_summary string, refine_summary string, reference_titles array<string>, triplets array<struct<subject:string,object:string>>")
    of = lambda a: {r["document_id"]: r["query"] for r in retrieval.derive_queries(state, a).collect()}
    head = ("dense " * 200)[:500].strip()
    assert of("concept_extractor") == {"d1": (("dense " * 200)[:500] + " entities: a, b, c").strip(), "d2": ""} and of("critic") == {"d1": head, "d2": ""}
    assert of("synthesizer")["d1"].endswith(" refine") and of("decontextualizer")["d1"].endswith("references: t1, t2") and of("reference_extractor")["d1"].endswith("citations bibliography references")
    assert retrieval.should_enrich("critic", True, {"critic"}) and not retrieval.should_enrich("critic", True) and not retrieval.should_enrich("synthesizer", False)
    vectors = state.select(F.lit("e1").alias("id"), F.lit("entity").alias("level"), models.embed(F.lit("x")).alias("embedding"), F.lit("known").alias("content")).limit(1)
    got = {r["document_id"]: r["context"] for r in retrieval.build_context(state, "synthesizer", models.embed, vectors).collect()}
    assert set(got) == {"d1", "d2"} and got["d2"] is None
    assert retrieval.build_context(state, "critic", models.embed, vectors).count() == 0
