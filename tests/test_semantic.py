"""Semantic fingerprints against exact similarity of all pairs."""

import numpy as np
import pandas as pd
import pytest

from factloom.operators import dealt, models, semantic


def _exact(vec, threshold):
    heads = {}
    for i in sorted(vec):
        heads.setdefault(vec[i].tobytes(), i)
    ids, out = sorted(heads.values()), {}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            m = vec[a] @ vec[b].T
            s = (m.max(1).sum() + m.max(0).sum()) / sum(m.shape)
            if s >= threshold:
                out[a, b] = s
    return out


@pytest.mark.parametrize("cell", [8, 2048])
def test_near_documents_against_exact_similarity(spark, monkeypatch, cell):
    """Rewrites at about the threshold, copies, a chunk that very many documents have, repeated chunks, null and empty embeddings, other columns."""
    for f in (dealt.meet, dealt.pairs):
        monkeypatch.setattr(f, "__defaults__", (cell,))
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    common = unit(rng.standard_normal(48))
    docs = {}
    for i in range(60):
        docs[i] = unit(rng.standard_normal((rng.integers(1, 7), 48)))
        if i % 3 == 0:
            docs[i] = np.vstack([docs[i], common])
    for i in range(60):
        noise = rng.choice([0.15, 0.25, 0.31, 0.35])
        docs[100 + i] = unit(docs[i] + noise * unit(rng.standard_normal(docs[i].shape)))
    for i in range(40):
        docs[300 + i] = docs[7]
    rows = [(i, v.tolist(), "x") for i, m in docs.items() for v in m] + [(5, docs[5][0].tolist(), "again"), (900, None, "x"), (901, [], "x"), (None, common.tolist(), "x")]
    df = spark.createDataFrame(rows, "document_id long, embedding array<double>, a string")
    want = _exact({i: np.array(sorted({tuple(v) for v in m.tolist()})) for i, m in docs.items()}, 0.95)
    got = {(r["a"], r["b"]): r["similarity"] for r in semantic.near_documents(df).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(want) > 30 and len(got) >= 0.9 * len(want)
    members = {r["document_id"]: r["class_id"] for r in semantic.classes(df).collect()}
    assert len(members) == len(docs) and members[5] == 5 and all(members[300 + i] == 7 for i in range(40))
    assert semantic.near_documents(df.limit(0)).count() == 0


def test_fingerprints_do_not_depend_on_batches(spark):
    v = np.random.default_rng(1).standard_normal((30, 8))
    df = spark.createDataFrame([(i % 4, x.tolist()) for i, x in enumerate(v)], "document_id int, embedding array<double>")
    rows = lambda n: {r["document_id"]: list(r["fingerprint"]) for r in semantic.fingerprints(df.repartition(n)).collect()}
    one = rows(1)
    assert one == rows(7) and one[2] == semantic.minhash(semantic.cells(v[2::4])).min(0).tolist()


def test_word_embedder():
    a, b, c, d, e = models.embed_words(pd.Series(["The cat", "cat the", "a dog", "", None]))
    assert a == b and d is None and e is None and abs(np.dot(a, a) - 1) < 1e-12 and np.dot(a, c) < 0.9


def test_registered_query(spark, sf):
    """The whole table of documents against all pairs."""
    from factloom.registry import QUERIES

    vec = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        m = {tuple(e) for e in models.embed_words(pd.Series((r["text"] or "").split("\n"))) if e is not None}
        if m:
            vec[r["doc_id"]] = np.array(sorted(m))
    want, got = _exact(vec, 0.95), {(r["a"], r["b"]) for r in QUERIES["semantic_variants"](spark, sf).collect()}
    assert got <= set(want) and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("cell", [4, 2048])
def test_prints_meet_in_cells_and_each_pair_comes_once(spark, monkeypatch, cell):
    """Many documents that are nearly alike agree in most bands; no row is made for a pair and a band, nor a fingerprint sent to a pair."""
    monkeypatch.setattr(dealt.blocks, "__defaults__", (cell,))
    rng = np.random.default_rng(8)
    m = np.tile(rng.integers(0, 1 << 31, semantic.VALUES), (50, 1))
    for row in m:
        at = rng.permutation(semantic.VALUES)[: rng.integers(0, 180)]
        row[at] = rng.integers(0, 1 << 31, len(at))
    found = semantic.candidates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "document_id long, fingerprint array<long>"))
    assert "arrays_zip" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["a"], r["b"]) for r in found.collect()]
    low = m & 0xFFFF
    same = lambda a, b: low[a] == low[b]
    want = {(a, b) for a in range(50) for b in range(a + 1, 50) if same(a, b).sum() >= semantic.AGREE and same(a, b).reshape(-1, semantic.BAND).all(1).any()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize("long, work", [(1024, 1), (1024, 1 << 26), (3, 1 << 20)])
def test_similarity_by_cells_of_any_size(spark, long, work):
    rng = np.random.default_rng(9)
    vec = {f"d{i}": rng.standard_normal((rng.integers(1, 6), 16)) for i in range(12)}
    vec = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in vec.items()}
    chunks = spark.createDataFrame([(k, x.tolist()) for k, v in vec.items() for x in v], "document_id string, embedding array<double>")
    want = _exact(vec, -2)
    got = {(r["a"], r["b"]): r["similarity"] for r in semantic.similarity(spark.createDataFrame(list(want), "a string, b string"), chunks, long, work).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_long_documents_agree_no_more_by_chance(spark):
    """Long documents filled all cells of their tables, so that any two of them agreed in a band and were compared chunk by chunk; copies with small changes still meet."""
    rng = np.random.default_rng(5)
    docs = [rng.standard_normal((150, 64)) for _ in range(30)]
    docs += [d / np.linalg.norm(d, axis=1, keepdims=True) + 0.25 * rng.standard_normal(d.shape) / 8 for d in docs]
    rows = [(i, v.tolist()) for i, d in enumerate(docs) for v in d]
    prints = semantic.fingerprints(spark.createDataFrame(rows, "document_id long, embedding array<double>"))
    got = {(r["a"], r["b"]) for r in semantic.candidates(prints).collect()}
    true = {(i, i + 30) for i in range(30)}
    assert len(got & true) >= 27 and len(got - true) <= 20


def test_groups_and_stars_are_compared_alike(spark):
    """A cell's documents as one product, and pair by pair, with chunks that many share and one hash for two vectors."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    shared = unit(rng.standard_normal((5, 16)))
    vec = {i: np.vstack([shared[rng.permutation(5)[: rng.integers(1, 5)]], unit(rng.standard_normal((rng.integers(1, 4), 16)))]) for i in range(40)}
    right = pd.DataFrame([(i, hash(v.tobytes()) % (2**62), v.tobytes()) for i, m in vec.items() for v in m], columns=["document_id", "chunk", "v"])
    want = _exact(vec, -2)
    for pairs in (list(want), [(0, i) for i in range(1, 40)], [(i, 39) for i in range(39)], [p for p in want if sum(p) % 5 == 0]):
        left = pd.DataFrame([(a % 3, a, b) for a, b in pairs], columns=["lead", "a", "b"])
        for told in (right, right.assign(chunk=0)):
            got = semantic._compare(left, told)
            assert list(zip(got["a"], got["b"], strict=True)) == pairs and all(abs(s - want[p]) < 1e-9 for p, s in zip(pairs, got["similarity"], strict=True))
