"""Every registered query of the library against DuckDB on the smallest tables."""

import pytest
from tests.compare import rows

from factloom.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    got, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_leader_clusters_cover_every_name(spark, sf):
    got = QUERIES["leader_clusters"](spark, sf).toPandas()
    assert len(got) == 500 and (got["leader"] <= got["name"]).all()
    assert got[got["name"] == got["leader"]]["name"].nunique() == got.groupby(["document_id", "leader"]).ngroups


def _pieces(nodes, edges):
    """Least node of each connected piece, by plain search."""
    near = {n: [] for n in nodes}
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    least = {}
    for n in sorted(nodes):
        stack = [n] if n not in least else []
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = n
                stack += near[x]
    return least


def test_communities_of_the_whole_graph(spark, sf):
    """A partition of all nodes, groups that hang together, named by their least node, at least as good as the one-task version."""
    from pyspark.sql import functions as F

    from factloom.operators import communities
    from factloom.plans.queries import _edges

    edges = _edges(spark, sf).select("src", "dst").persist()
    pairs = [tuple(r) for r in edges.filter("src != dst").collect()]
    parts = QUERIES["louvain_communities"](spark, sf).persist()
    of = {r["node"]: r["component"] for r in parts.collect()}
    assert set(of) == {n for p in pairs for n in p} and len(of) == parts.count()
    assert of == _pieces(of, [(u, v) for u, v in pairs if of[u] == of[v]])
    score = lambda p: communities.modularity(p, edges).first()[0]
    assert score(parts) >= 0.98 * score(communities.leiden(edges.withColumn("document_id", F.lit(1))))


def test_label_propagation_ends_where_nothing_would_change(spark, sf):
    from collections import Counter

    from factloom.plans.queries import _edges

    label = {r["node"]: r["component"] for r in QUERIES["label_propagation"](spark, sf).collect()}
    near = {n: set() for n in label}
    for u, v in _edges(spark, sf).select("src", "dst").filter("src != dst").collect():
        near[u].add(v)
        near[v].add(u)
    for n, around in near.items():
        seen = Counter([label[x] for x in around] + [label[n]])
        assert label[n] == min(seen, key=lambda x: (-seen[x], x))


def test_html_strings_drop_scripts(spark, sf):
    got = QUERIES["html_strings_text"](spark, sf).toPandas()
    assert len(got) == 50 and not got["text"].str.contains("track\\(").any()


def test_retrieved_context_is_headed(spark, sf):
    got = QUERIES["retrieve_context"](spark, sf).toPandas()
    assert len(got) and got["context"].str.startswith("## ").all() and got["query_id"].is_unique


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
