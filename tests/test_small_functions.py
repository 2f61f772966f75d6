"""Functions that no registered query calls: their results by hand."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import chunking, communities, entities, facts, models
from factloom.sources import stores
from factloom.sources.stores import Table
from factloom.streaming import ingest


def test_sections_of_chunks(spark):
    chunks = spark.createDataFrame([("d", 0, "Intro and Methods stand here; results too. " + "x" * 300 + " Late"), ("d", 1, "nothing"), ("e", 0, "Intro")], "document_id string, position int, content string")
    sections = spark.createDataFrame([("d", 2, "Methods"), ("d", 1, "Intro"), ("d", 3, "RESULTS"), ("d", 4, "too"), ("d", 5, "Late")], "document_id string, ord int, title string")
    got = {(r["document_id"], r["position"]): r["source_sections"] for r in chunking.attribute_sections(chunks, sections).collect()}
    assert got == {("d", 0): ["Intro", "Methods", "RESULTS"], ("d", 1): [], ("e", 0): []}


def test_communities_are_integrated(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("x",)], "node_id string")
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "gone"), ("h", "x")], "component string, node string")
    covered = spark.createDataFrame([("g", ["c1", "c2", "c3", "c4"]), ("h", ["c2", "c3", "c4"])], "component string, chunks array<string>")
    topics, edges = communities.integrate(nodes, members, covered)
    assert {(r["node_id"], r["layer"], r["occurrence_count"], len(r["source_chunk_ids"])) for r in topics.collect()} == {("g", 1, 3, 4), ("h", 1, 1, 3)}
    assert {(r["src"], r["dst"], r["relation_type"], r["confidence"]) for r in edges.collect()} == {("g", "a", "encompasses", 1.0), ("g", "b", "encompasses", 1.0), ("h", "x", "encompasses", 1.0), ("g", "h", "related_to", 0.75)}


def test_names_of_clusters(spark):
    rows = spark.createDataFrame([("d", "EU", "EU"), ("d", "European Union", "EU"), ("d", "european union", "EU"), ("d", "Paris", "Paris")], "document_id string, name string, leader string")
    got = {r["canonical"]: r["aliases"] for r in entities.canonical_names(rows).collect()}
    assert got == {"European Union": ["EU", "european union"], "Paris": []}


def test_three_passes_at_once(spark):
    raw = spark.createDataFrame([(1, "EU", "regulates", "steel", "c1", 0.8, "s"), (2, "European Union", "regulates", "steel", "c2", 0.9, "t")], "seq long, subject string, predicate string, object string, source_chunk_id string, confidence double, context_sentence string")
    clusters = spark.createDataFrame([("European Union", ["EU"])], "canonical string, aliases array<string>")
    assert facts.merge(raw).count() == 2
    one = facts.merge(raw, clusters).collect()
    assert [(r["subject"], r["occurrence_count"]) for r in one] == [("European Union", 2)]


def test_annexes_and_prompt_hashes(spark):
    rows = spark.createDataFrame([("Annex A",), ("the APPENDIX",), ("Chapter 1",), ("annexed lands",)], "t string")
    assert [r[0] for r in rows.select(X.is_annex(F.col("t"))).collect()] == [True, True, False, False]
    assert models.prompt_hash("ab") == hashlib.sha256(b"ab").hexdigest()[:16] != models.prompt_hash("ac")


def test_csv_has_the_columns_asked_for(spark, tmp_path):
    stores.export_csv(spark.createDataFrame([("a", 1, 2)], "agent string, x int, y int"), f"file://{tmp_path}/c", ["agent", "missing", "y"])
    lines = [x for f in (tmp_path / "c").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted({x.replace(chr(34) * 2, "") for x in lines}) == ["a,,2", "agent,missing,y"]  # each part has the header


def test_tokens_that_are_used_up(spark):
    calls = spark.createDataFrame([("d", "critic", 3, 4), ("d", "critic", 1, 1), ("e", "critic", 5, 0)], "document_id string, agent string, input_tokens long, output_tokens long")
    assert {tuple(r) for r in ingest.consumed_tokens(calls).collect()} == {("d", "critic", 9), ("e", "critic", 5)}


def _stream(spark, folder):
    return spark.readStream.schema("k string, v int").parquet(str(folder))


def test_streams_into_stores_and_passes(spark, tmp_path):
    folder, table = tmp_path / "in", Table(spark, f"file://{tmp_path}/t", ["k"])
    seen = []
    for rows in ([("a", 1), ("b", 1)], [("a", 2), ("c", 2)]):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(str(folder))
        ingest.upsert_stream(_stream(spark, folder), table, f"{tmp_path}/c1").awaitTermination()
        ingest.consolidate_stream(_stream(spark, folder), lambda batch: seen.append(batch.count()), f"{tmp_path}/c2").awaitTermination()
    assert {tuple(r) for r in table.read().select("k", "v").collect()} == {("a", 2), ("b", 1), ("c", 2)}
    assert seen == [2, 2] and ingest.consolidate_stream(_stream(spark, folder), seen.append, f"{tmp_path}/c3", "manual") is None
    with pytest.raises(KeyError):
        ingest.consolidation_trigger("never")


def test_of_equal_new_files_the_least_path_stays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("z.txt", "Same words"), ("b.txt", "Same words"), ("m.txt", "same WORDS!"), ("other.txt", "Another")):
        (tmp_path / "in" / name).write_text(text)
    time.sleep(0.1)
    ingest.ingest_files(spark, f"{tmp_path}/in", f"file://{tmp_path}/cache", f"{tmp_path}/c").awaitTermination()
    kept = {r["document_id"].rsplit("/", 1)[1] for r in Table(spark, f"file://{tmp_path}/cache", ["document_id"]).read().collect()}
    assert kept == {"b.txt", "other.txt"}
