"""A graph rebuilt from files, killed and resumed; facts that go stale in a stream across restarts, against the batch and by hand."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.sources import rebuild, stores
from factloom.streaming import freshness


def _write(root, document, run, nodes, links, text=None):
    at = root / document / "runs" / run / "04_synthesis"
    at.mkdir(parents=True, exist_ok=True)
    (at / "graph.json").write_text(text or json.dumps({"directed": True, "nodes": nodes, "links": links}))


def _state(b):
    nodes = {r["node_id"]: (r["occurrence_count"], r["confidence"], r["corroboration"]) for r in b.graph.nodes.read().collect()}
    edges = {(r["src"], r["relation_type"], r["dst"]): (r["occurrence_count"], r["corroboration"]) for r in b.graph.edges.read().collect()}
    return nodes, edges


def test_rebuild_merges_by_document_and_resumes(spark, tmp_path, monkeypatch):
    src = tmp_path / "out"
    n = lambda i, c=1, p=0.5: {"id": i, "occurrence_count": c, "confidence": p}
    e = lambda a, b, c=1: {"source": a, "target": b, "relation_type": "r", "occurrence_count": c, "confidence": 0.5}
    _write(src, "a", "2024", [n("x", 9), n("old")], [e("x", "old")])
    _write(src, "a", "2025", [n("x", 2), n("y"), {"id": None}], [e("x", "y"), {"source": "x", "target": None, "relation_type": "r"}])
    _write(src, "b", "2025", [n("x", 3, 0.9), {"id": "z"}], [e("x", "z", 4)])
    _write(src, "c", "2025", [], [], "not json")
    b = rebuild.Rebuild(spark, f"file://{tmp_path}/db", buckets=3)
    assert b.update(f"file://{src}", batch=2) == {"files": 3, "errors": 1}
    first = ({"x": (5, 0.9, 2), "y": (1, 0.5, 1), "z": (1, 0.0, 1)}, {("x", "r", "y"): (1, 1), ("x", "r", "z"): (4, 1)})
    assert _state(b) == first
    assert b.update(f"file://{src}") == {"files": 0, "errors": 0} and _state(b) == first
    assert {r["document_id"] for r in b.documents_of(spark.createDataFrame([("x",)], "node_id string")).collect()} == {"a", "b"}
    # a newer run of a, which is killed after each of its steps in turn
    _write(src, "a", "2026", [n("x", 1), n("w")], [e("w", "x")])
    second = ({"x": (4, 0.9, 2), "w": (1, 0.5, 1), "z": (1, 0.0, 1)}, {("w", "r", "x"): (1, 1), ("x", "r", "z"): (4, 1)})
    for step in range(7):
        real, calls = stores.Table._put, [0]

        def dies(self, *args, real=real, calls=calls, step=step):
            if calls[0] == step:
                raise KeyboardInterrupt
            calls[0] += 1
            return real(self, *args)

        monkeypatch.setattr(stores.Table, "_put", dies)
        with pytest.raises(KeyboardInterrupt):
            rebuild.Rebuild(spark, f"file://{tmp_path}/db", buckets=3).update(f"file://{src}")
        monkeypatch.setattr(stores.Table, "_put", real)
    b = rebuild.Rebuild(spark, f"file://{tmp_path}/db", buckets=3)
    assert b.update(f"file://{src}")["files"] == 1 and _state(b) == second
    b.remove(spark.createDataFrame([("b",)], "document_id string"))
    assert _state(b) == ({"x": (1, 0.5, 1), "w": (1, 0.5, 1)}, {("w", "r", "x"): (1, 1)})
    assert b.update(f"file://{src}")["files"] == 1 and _state(b) == second


def test_export_is_rebuilt(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 2, 0.5, 2), ('q"\n', 1, 0.7, 3)], "node_id string, occurrence_count long, confidence double, layer int")
    edges = spark.createDataFrame([("a", 'q"\n', "r", 2, 0.7)], "src string, dst string, relation_type string, occurrence_count long, confidence double")
    stores.export_graph(nodes, edges, f"file://{tmp_path}/parts", "json")
    (tmp_path / "out/d/runs/1/04_synthesis").mkdir(parents=True)
    stores.joined(spark, f"file://{tmp_path}/parts", f"file://{tmp_path}/out/d/runs/1/04_synthesis/graph.json")
    b = rebuild.Rebuild(spark, f"file://{tmp_path}/db", buckets=2)
    assert b.update(f"file://{tmp_path}/out")["errors"] == 0
    assert sorted(b.graph.nodes.read().select(*nodes.columns).collect()) == sorted(nodes.collect())
    assert b.graph.edges.read().select(*edges.columns).collect() == edges.collect()


def _day(x):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=x)


def test_transitions_by_hand(spark):
    """Half-life 10 days: stale after 3.219 days, gone 20 days later."""
    rows = [("one", "d", _day(0)), ("again", "d", _day(0)), ("again", "d", _day(3)), ("again", None, _day(8)), ("dead", "d", _day(0)), ("dead", "e", _day(30)), ("dead", "e", _day(60)), ("two", "d", _day(0)), ("two", "d", _day(0)), ("two", "e", _day(1))]
    rows += [(None, "d", _day(0)), ("none", "d", None)]
    got = {}
    for r in freshness.transitions(spark.createDataFrame(rows, "fact_id string, document_id string, at timestamp"), half_life=10.0).orderBy("at").collect():
        got.setdefault(r["fact_id"], []).append((r["status"], round((r["at"] - _day(0)).total_seconds() / 86400, 2)))
    assert got == {
        "one": [("fresh", 0), ("stale", 3.22), ("deleted", 23.22)],
        "again": [("fresh", 0), ("stale", 6.22), ("fresh", 8)],  # two documents from then on
        "dead": [("fresh", 0), ("stale", 3.22), ("deleted", 23.22), ("fresh", 30), ("stale", 33.22), ("deleted", 53.22), ("fresh", 60), ("stale", 63.22), ("deleted", 83.22)],
        "two": [("fresh", 0)],
    }
    until = freshness.transitions(spark.createDataFrame(rows, "fact_id string, document_id string, at timestamp"), F.lit(_day(10)), 10.0)
    assert {r["status"] for r in until.filter("fact_id = 'one'").collect()} == {"fresh", "stale"}


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        t = rng.uniform(0, 5)
        for _ in range(rng.randrange(1, 7)):
            rows.append((f"f{i}", "d" if rng.random() < 0.85 else "e", _day(t)))
            t += rng.choice([0.0, 0.5, 3.3, 12, 24, 40])
    rows.sort(key=lambda r: r[2])
    kind = "fact_id string, document_id string, at timestamp"
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [[("tick", "d", _day(900))], [("tock", "d", _day(901))]]
    for p in parts[:3]:
        rng.shuffle(p)
    key, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, p in enumerate(parts):
            spark.createDataFrame(p, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            q = freshness.stream(spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "1 day", 10.0)
            run = q.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(key, was)
    want = freshness.transitions(spark.createDataFrame(rows, kind), half_life=10.0)
    got = spark.read.parquet(f"{tmp_path}/out").filter("fact_id like 'f%'")
    plain = lambda df: sorted((r["fact_id"], r["at"], r["status"]) for r in df.collect())
    assert plain(got) == plain(want) and len({r[2] for r in plain(got)}) == 3
