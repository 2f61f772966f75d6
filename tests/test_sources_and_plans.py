import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import models
from factloom.plans import stages
from factloom.sources import readers, stores
from factloom.streaming import ingest


def _docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in (["a", "b"], ["1"])) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{table}</w:body></w:document>")
    return out.getvalue()


def _epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.xhtml", "<html><head><title>t</title></head><body><p>second</p></body></html>")
        z.writestr("a.xhtml", "<html><body><p>first <b>bold</b></p><img alt='cat'/><script>x()</script></body></html>")
    return out.getvalue()


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"caf\xc3\xa9 \xff", "b.MD": b"# T\n![x](u.png)", "c.docx": _docx([("Heading1", "Top"), (None, "text")]), "d.epub": _epub(), "e.png": b"12345", "f.exe": b"", "sub/g.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.scan(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.extract(files).collect()}
    assert set(got) == {"a.txt", "b.MD", "c.docx", "d.epub", "e.png", "g.docx"}
    assert got["a.txt"]["raw_text"] == "café �" and got["b.MD"]["images"] == ["u.png"]
    assert got["c.docx"]["raw_text"] == "# Top\n\ntext\n\n| a | b |\n| --- | --- |\n| 1 |  |"
    assert "first\nbold" in got["d.epub"]["raw_text"] and got["d.epub"]["images"] == ["cat"] and "x()" not in got["d.epub"]["raw_text"]
    assert "image/png" in got["e.png"]["raw_text"] and got["g.docx"]["raw_text"] is None and got["g.docx"]["error"]
    assert readers.scan(spark, str(tmp_path), recursive=False, formats=["txt"]).count() == 1


def test_oversize_modes(spark):
    df = spark.createDataFrame([("x" * 100,), ("y" * 8,)], "text string")
    assert readers.oversize(df, "text", 5, "reject").count() == 1
    assert {len(r[0]) for r in readers.oversize(df, "text", 5).collect()} == {20, 8}
    assert {len(r[0]) for r in readers.oversize(df, "text", 10, "sample").collect()} == {10 * 4 + 9, 8}


def test_table_upsert_and_delete(spark, tmp_path):
    t = stores.Table(spark, f"file://{tmp_path}/t", ["id"])
    assert not t.exists() and t.count() == 0
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    t.delete(spark.createDataFrame([(1,)], "id int"))
    assert t.count() == 2


def test_vector_store_filters_before_ranking(spark, tmp_path):
    s = stores.VectorStore(spark, f"file://{tmp_path}/v")
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x", {"k": "1"}), ("b", [0.9, 0.1], "y", {"k": "2"})], "id string, embedding array<double>, document string, metadata map<string,string>")
    s.upsert("chunks", rows)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r["id"] for r in s.query("chunks", q, 1).collect()] == ["a"]
    assert [r["id"] for r in s.query("chunks", q, 1, {"k": 2}).collect()] == ["b"]
    assert s.count("chunks") == 2 and s.count("other") == 0


def test_graph_store_cascades_and_exports(spark, tmp_path):
    g = stores.GraphStore(spark, f"file://{tmp_path}/g")
    nodes = spark.createDataFrame([("a",), ("b & c",), ("d",)], "node_id string")
    edges = spark.createDataFrame([("a", "b & c", "is_a"), ("d", "a", "part_of")], "src string, dst string, relation_type string")
    g.import_graph(nodes, edges)
    assert g.edges_of("a").count() == 2 and g.edges_of("a", "out", "is_a").count() == 1
    for kind in ("json", "graphml", "gexf", "cypher"):
        stores.export_graph(nodes, edges, f"{tmp_path}/{kind}", kind)
        text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/{kind}").collect())
        assert "b & c" in text or "b &amp; c" in text
        if kind in ("graphml", "gexf"):
            from xml.etree import ElementTree

            parts = sorted((tmp_path / kind).glob("part-*"))
            ElementTree.fromstring("".join(p.read_text() for p in parts))
    g.delete_node("a")
    assert g.nodes.count() == 2 and g.edges.count() == 0


def test_runs_carry_steps_and_point_to_latest(spark, tmp_path):
    r = stores.Runs(spark, f"file://{tmp_path}", "doc1")
    r.create("run1")
    r.complete_step("run1", "02_chunks", spark.range(3), "d1")
    r.finalize("run1")
    r.create("run2", carried_from="run1")
    assert r.read_step("run2", "02_chunks").count() == 3 and r.latest() == "run1"
    r.finalize("run2")
    assert r.latest() == "run2" and r.manifest("run2")["status"] == "done"


def test_levels_and_errors():
    assert stages.levels({"c": ["a", "b"], "a": [], "b": ["a"]}) == [["a"], ["b"], ["c"]]
    with pytest.raises(stages.PlanError):
        stages.levels({"a": ["b"], "b": ["a"]})
    with pytest.raises(stages.PlanError):
        stages.levels({"a": ["x"]})


def test_run_retries_gates_and_isolates(spark):
    turns = {"n": 0}

    def flaky(state):
        turns["n"] += 1
        if turns["n"] < 3:
            raise ValueError("again")
        return {"x": 1}

    def broken(state):
        raise KeyError("no")

    steps = [stages.Step("flaky", flaky), stages.Step("low", lambda s: {"y": 2}, confidence=lambda o: 0.1), stages.Step("broken", broken), stages.Step("after", lambda s: {"z": 3}, ("broken",)), stages.Step("sum", lambda s: {"t": s["x"] + s["y"]}, ("flaky", "low"))]
    out = stages.run(stages.Registry(steps), {})
    by = {r.name: r for r in out.reports}
    assert out.state["t"] == 3 and by["flaky"].attempts == 3 and by["low"].ok and by["low"].attempts == 3
    assert not by["broken"].ok and by["after"].error and out.frame(spark).count() == 5
    with pytest.raises(RuntimeError):
        stages.run(stages.Registry(steps[2:3]), {}, fail_fast=True)


def test_passes_are_isolated():
    done = []
    out = stages.consolidate_corpus({}, {"linking": lambda s: {"a": 1}, "clustering": lambda s: 1 / 0, "decay": lambda s: done.append(s["a"]) or {}})
    assert [r.ok for r in out.reports] == [True, False, True] and done == [1]
    assert stages.resume(["a", "b", "c"], "b") == ["b", "c"]


def test_model_boundary(spark):
    rows = spark.createDataFrame([("d", 0, "one"), ("d", 1, "two")], "document_id string, position int, content string")
    p = rows.withColumn("prompt", models.render(models.PROMPTS["concept_extractor"], language=F.lit("en"), content=F.col("content")))
    answers = models.complete(p, "prompt", lambda: models.StubClient(('```json\n[{"subject":"a","predicate":"is","object":"b"}]\n```', "nonsense")))
    parsed = models.parse_facts(answers.repartition(1))
    assert parsed.filter("subject = 'a'").count() >= 1
    assert models.refine(rows).first()["steps"] == 2 and models.densify(spark.createDataFrame([("d", "s")], "document_id string, summary string")).count() == 1
    v = rows.select(models.embed(F.col("content")).alias("v")).first()["v"]
    assert len(v) == 128 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert models.route("x", {"x": "", "phase1": "p:m"}, {"x": "phase1"}) == ("p", "m") and models.route("y", {}) == ("stub", "default")


def test_streams(spark, tmp_path, sf):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Hello, world")
    (src / "b.txt").write_text("other")
    cache, cp = f"file://{tmp_path}/cache", f"{tmp_path}/cp"
    ingest.ingest_files(spark, str(src), cache, cp).awaitTermination(60)
    (src / "c.txt").write_text("hello world")  # same content after normalising
    (src / "d.txt").write_text("new")
    ingest.ingest_files(spark, str(src), cache, cp).awaitTermination(60)
    assert stores.Table(spark, cache, ["document_id"]).count() == 3
    from factloom.plans.inputs import calls

    calls(spark, sf).write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/calls").schema).parquet(f"{tmp_path}/calls")
    q = ingest.daily_stats(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("daily").agg(F.sum("calls")).first()[0] == 1000
