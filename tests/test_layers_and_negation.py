"""Denied statements by hand, edges to literals, and what topics encompass against plain sets."""

import random

from factloom.operators import communities, graph, reasoning


def test_negations_by_hand(spark):
    rows = [("X", "requires", "Y", 1), ("x", "does not require", "y", 2), ("X", "Never_Requires", "Y", 3), ("X", "requires no longer", "Y", 4), ("X", "uses", "Y", 5)]
    rows += [("A", "is", "B", 6), ("a", "isn't", "B", 7), ("A", "is not", "b", 8), ("P", "has", "Q", 9), ("P", "doesn't have", "Q", 10), ("M", "est", "N", 11), ("M", "n'est pas", "N", 12), ("K", "can use", "L", 13), ("K", "cannot use", "L", 14)]
    rows += [("only", "not", "Y", 15), ("Z", "knows", "Y", 16), ("Z", "notes", "Y", 17), (None, "is", "B", 18), ("A", None, "B", 19), ("X", "does not require", "other", 20)]
    got = {(r["subject"], r["object"]): tuple(r)[2:] for r in reasoning.negations(spark.createDataFrame(rows, "subject string, predicate string, object string, seq long")).collect()}
    assert got == {
        ("x", "y"): ("require", 1, 3, 1, 2), ("p", "q"): ("have", 1, 1, 9, 10), ("m", "n"): ("est", 1, 1, 11, 12), ("k", "l"): ("can use", 1, 1, 13, 14), ("a", "b"): ("is", 1, 2, 6, 7),
    }


def test_edges_to_literals(spark):
    rows = [("Plant", "42", 0.5, None), ("Plant", "42", 0.9, " "), ("Plant", "42", 0.7, "2020"), ("Plant", "Town", 0.9, None), ("42", "7", 0.9, None), (None, "7", 0.9, None), ("Plant", None, 0.9, None)]
    got = graph.attribute_edges(spark.createDataFrame(rows, "subject string, object string, confidence double, temporal_scope string")).collect()
    assert sorted(map(tuple, got)) == [("Plant", "42", "has_attribute", 2, 0.9), ("Plant", "42", "measured_at", 1, 0.7)]


def test_encompassed_nodes_equal_plain_sets(spark):
    rng = random.Random(2)
    topics = [(t, rng.sample(range(30), rng.randrange(1, 9))) for t in range(40)] + [(90, []), (91, None), (92, [999]), (93, [1, 1, 998])]
    nodes = [(f"n{i}", rng.sample(range(30), rng.randrange(1, 25))) for i in range(40)] + [("all", list(range(30)) * 2), ("none", []), ("null", None)]
    df = communities.encompasses(spark.createDataFrame(topics, "component long, chunks array<int>"), spark.createDataFrame(nodes, "node_id string, source_chunk_ids array<int>"))
    want = {(t, n, len(set(c) & set(h or [])) / len(set(c))) for t, c in topics if c for n, h in nodes if 2 * len(set(c) & set(h or [])) >= len(set(c))}
    got = [(r["src"], r["dst"], r["confidence"]) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) and (93, "all", 0.5) in want
