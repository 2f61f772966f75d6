"""Variants by section constellations and lookups in earlier chunks, against plain Python."""

import math
import random

import pytest

from factloom.operators import constellation, dealt, lookup


def test_anchor_takes_title_first_and_last_sentence(spark):
    rows = [(1, "T", "First one. Middle! Last one?"), (2, "t ", "  first   one. Other. last one?"), (3, "U", "First one. Last one?"), (4, None, "First one."), (5, "", "first one."), (6, "", None)]
    got = {r["i"]: r["a"] for r in spark.createDataFrame(rows, "i int, title string, content string").select("i", constellation.anchor(*map(__import__("pyspark.sql.functions").sql.functions.col, ("title", "content"))).alias("a")).collect()}
    assert got[1] == got[2] and got[4] == got[5] and len({got[1], got[3], got[4], got[6]}) == 4 and all(len(a) == 16 for a in got.values())


@pytest.mark.parametrize("cell", [4, 2048])
def test_variants_equal_brute_force(spark, monkeypatch, cell):
    """Copies, excerpts, an anchor that every document has, empty sets, equal sizes, exact thresholds."""
    monkeypatch.setattr(dealt.meet, "__defaults__", (cell,))
    rng = random.Random(8)
    sets = []
    for i in range(60):
        n = rng.choice([1, 3, 5, 10, 20])
        sets.append((i, sorted({"common", *(f"a{rng.randrange(4000)}" for _ in range(n - 1))})))
    for i in range(60, 90):
        base = rng.choice(sets)[1]
        part = set(rng.sample(base, max(1, math.ceil(0.7 * len(base)) - i % 2)))
        sets.append((i, sorted(part | {f"b{rng.randrange(4000)}" for _ in range(i % 9)})))
    sets += [(100 + i, sets[4][1]) for i in range(40)] + [(200, []), (201, None)]
    sets += [(300, [f"x{k}" for k in range(10)]), (301, [f"x{k}" for k in range(7)] + [f"y{k}" for k in range(9)]), (302, [f"x{k}" for k in range(6)] + [f"z{k}" for k in range(9)])]
    df = spark.createDataFrame(sets, "document_id long, anchors array<string>")
    reps = {}
    for i, s in sets:
        if s:
            reps.setdefault(tuple(s), i)
            reps[tuple(s)] = min(reps[tuple(s)], i)
    want = set()
    for s, i in reps.items():
        for t, j in reps.items():
            k = len(set(s) & set(t))
            if (len(s), i) < (len(t), j) and 10 * k >= 7 * len(s):
                want.add((i, j, k))
    got = constellation.variants(df).collect()
    assert {(r["small_id"], r["large_id"], r["shared"]) for r in got} == want and len(got) == len(want) and (300, 301, 7) in want
    members = {r["document_id"]: r["class_id"] for r in constellation.classes(df.filter("size(anchors) > 0")).collect()}
    assert members == {i: reps[tuple(s)] for i, s in sets if s}


def test_lookup_sees_earlier_chunks_only(spark):
    rng = random.Random(3)
    chunks = [(d, p, f"{d}-{p}", f"text {p} " + "x" * 700, [rng.uniform(-1, 1) for _ in range(6)]) for d in "ab" for p in range(12)] + [("a", 5, "a-tie", "t", None), ("c", 0, "c-0", "only", [1.0] * 6), ("c", None, "c-n", "lost", [1.0] * 6)]
    df = spark.createDataFrame(chunks, "document_id string, position int, id string, content string, embedding array<double>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    known = [c for c in chunks if c[4] and c[1] is not None]
    want = {}
    for c in known:
        best = sorted(((-cos(c[4], o[4]), o[1], o[2]) for o in known if o[0] == c[0] and o[1] < c[1]))[:3]
        want[c[0], c[1]] = [x[2] for x in best]
    got = {}
    for r in lookup.chunk_lookup(df.select("document_id", "position", "embedding"), df).orderBy("rank").collect():
        got.setdefault((r["document_id"], r["position"]), []).append(r["chunk_id"])
        assert len(r["content_excerpt"]) <= lookup.EXCERPT
    assert got == {k: v for k, v in want.items() if v}
    from pyspark.sql import functions as F

    first = df.filter("embedding is not null and position is not null").withColumn("resolution_confidence", F.when(F.col("position") % 3 == 0, 0.9).when(F.col("position") % 3 == 1, 0.69))
    for mode, asked in (("never", lambda p: False), ("auto", lambda p: p % 3 != 0), ("always", lambda p: True)):
        out = lookup.lookup_again(first, df, mode).collect()
        assert len(out) == len(known)
        for r in out:
            found = None if r["found"] is None else [h["chunk_id"] for h in r["found"]]
            assert found == (want[r["document_id"], r["position"]] if asked(r["position"]) else None)
    with pytest.raises(ValueError):
        lookup.lookup_again(first, df, "sometimes")
