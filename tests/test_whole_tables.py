"""Queries over whole tables against plain Python: no row is left out by its id."""

from collections import defaultdict
from datetime import timedelta

import numpy as np

from factloom.registry import QUERIES


def _read(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def test_value_conflicts_of_all_parts(spark, sf):
    first = {}
    for key, name, size in sorted(_read(spark, sf, "part", "p_partkey", "p_name", "p_size")):
        first.setdefault((name.lower(), str(size)), key)
    want = {(s, "has_size", a, b) for (s, a), i in first.items() for (t, b), j in first.items() if s == t and i < j}
    assert {tuple(r) for r in QUERIES["value_conflicts"](spark, sf).collect()} == want and want


def test_temporal_conflicts_of_all_orders(spark, sf, duck):
    by_customer = defaultdict(list)
    for customer, key, day in _read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate"):
        by_customer[customer].append((key, day))
    want = {(c, "ordered", a, b) for c, rows in by_customer.items() for a, x in rows for b, y in rows if a < b and abs(x - y) < timedelta(20)}
    assert {tuple(r) for r in QUERIES["temporal_conflicts"](spark, sf).collect()} == want and want


def test_contradictions_of_all_suppliers(spark, sf):
    supplier, part = dict(_read(spark, sf, "supplier", "s_suppkey", "s_name")), dict(_read(spark, sf, "part", "p_partkey", "p_name"))
    pairs = {(s, p) for s, p in _read(spark, sf, "lineitem", "l_suppkey", "l_partkey") if p % 10 == 0 and s in supplier and p in part}
    want = {f"Opposing predicates 'contains' and 'excludes' for ({supplier[s].lower()}, {part[p].lower()} #{p})." for s, p in pairs}
    got = QUERIES["contradictions"](spark, sf).filter("kind = 'opposing_predicate'").collect()
    assert {r["detail"] for r in got} == want and len(got) == len(want) and len({s for s, _ in pairs}) > 5


def test_searches_ask_a_hundredth_of_all_rows(spark, sf):
    rows = sorted(_read(spark, sf, "embeddings", "vec_id", "embedding"))
    ids, v = [i for i, _ in rows], np.array([e for _, e in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    top, blended = {}, {}
    for q in (i for i in ids if i % 100 == 0):
        score = dict(zip(ids, v @ v[ids.index(q)], strict=True))
        best = sorted(ids, key=lambda i: (-score[i], i))
        top[q] = best[:5]
        mixed = {i: 0.3 * score[i] + 0.7 * (i % 10 / 10 if i % 2 == 0 else 0) for i in best[:20]}
        blended[q] = sorted((i for i in mixed if mixed[i] >= 0.25), key=lambda i: (-mixed[i], i))
    for name, want in (("vector_top_k", top), ("entity_retrieval", blended)):
        got = defaultdict(list)
        for r in QUERIES[name](spark, sf).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["id"])
        assert dict(got) == {q: x for q, x in want.items() if x}
    assert len(top) == len([i for i in ids if i % 100 == 0]) and all(x[0] == q for q, x in top.items())


def test_context_for_a_hundredth_of_all_rows(spark, sf):
    want = {i for (i,) in _read(spark, sf, "embeddings", "vec_id") if i % 100 == 0}
    assert {r["query_id"] for r in QUERIES["retrieve_context"](spark, sf).collect()} == want


def test_lists_find_nine_in_ten_neighbours(spark, sf):
    from factloom.operators import entities, retrieval, vectors

    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    exact = {(r["query_id"], r["id"]) for r in QUERIES["vector_top_k"](spark, sf).collect()}
    got = {(r["query_id"], r["id"]) for r in QUERIES["vector_lists"](spark, sf).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)
    index = vectors.fit(v, 5, lists=16)
    assert index.recall >= 0.95 and 1 <= index.probes <= 16
    q = v.withColumnRenamed("id", "query_id")
    want = {(r["query_id"], r["id"]) for r in retrieval.top_k(q, v, 5).collect()}
    found = {(r["query_id"], r["id"]) for r in vectors.search(q, v, 5, index).collect()}
    assert len(found & want) >= 0.9 * len(want)
    whole = vectors.Lists(index.centres, 16, 1.0)
    assert {(r["query_id"], r["id"]) for r in vectors.search(q, v, 5, whole).collect()} == want
    a, b = v.filter("id % 2 = 0"), v.filter("id % 2 = 1")
    near = lambda f: {(r["left_id"], r["right_id"]) for r in f(a, b, 0.25).collect()}
    assert len(near(vectors.nearest) & near(entities.nearest)) >= 0.9 * len(near(entities.nearest))
    assert vectors.search(q, v.limit(0), 3).count() == 0 and vectors.search(q.limit(0), v, 3).count() == 0


def test_lists_in_many_cells(spark, monkeypatch):
    from factloom.operators import retrieval, vectors

    monkeypatch.setattr(vectors, "CELL", 7)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 0.05 + (1 if i % 3 == 0 else i % 5 - 2)).tolist()) for i in range(150)]  # a third in one place
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "query_id")
    index = vectors.fit(v, 3, lists=5)
    want = {(r["query_id"], r["id"]) for r in retrieval.top_k(q, v, 3).collect()}
    found = {(r["query_id"], r["id"]) for r in vectors.search(q, v, 3, index).collect()}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
