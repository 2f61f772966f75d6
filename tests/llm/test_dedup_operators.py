"""MinHash, windows, repeated bytes and exact dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import exact_dedup, minhash, phrase_dedup, textkit, window_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def shingles(text):
    w = words(text, True)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def check_minhash(df):
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    got = {r[0]: tuple(r)[1:] for r in minhash.near_dedup(df).collect()}
    assert got == brute_components(texts)


def test_minhash_on_the_table(spark, sf):
    check_minhash(spark.read.parquet(f"{sf}/documents.parquet"))


def test_minhash_on_odd_rows(odd_docs, no_docs):
    check_minhash(odd_docs)
    assert minhash.near_dedup(no_docs).count() == 0


@pytest.fixture(scope="module")
def near_group(spark):
    """A group whose members are like some others only, as chains and mutual strangers, in several blocks."""
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = base[:]
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_minhash_in_many_blocks(near_group, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    check_minhash(near_group)


def test_pruning_keeps_what_reaches_the_threshold():
    table = minhash.prune_table(0.75, 1e-6)
    assert len(table) == minhash.BANDS * minhash.ROWS // minhash.BATCH and all(a <= b for a, b in zip(table, table[1:], strict=False))
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (4000, 200), dtype=np.uint16)
    for share, low, high in ((0.76, 0.999, 1.0), (0.3, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < share, a, a + np.uint16(1))
        assert low <= len(minhash.survivors(a, b, 0.75, 1e-6)) / len(a) <= high


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    errors = []
    for share in (0.5, 0.75, 0.9):
        n = int(1000 * 2 * share / (1 + share))
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:n], pool[2000 : 3000 - n]]))
        s = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        errors.append(abs((s[0] == s[1]).mean() - n / (2000 - n)))
    assert max(errors) < 0.12


def brute_windows(texts, width=50):
    w = {i: words(t) for i, t in texts.items()}
    first = {}
    for i in sorted(w):
        for k in range(len(w[i]) - width + 1):
            first.setdefault(tuple(w[i][k : k + width]), i)
    out = {}
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if first[tuple(x[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_windows_on_odd_rows_whatever_the_batches(odd_docs, batches):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    got = {r[0]: tuple(r)[1:] for r in window_index.substring_dedup(odd_docs, batches=batches, with_text=True).collect()}
    assert got == brute_windows(texts)


def test_windows_on_the_table(spark, sf, no_docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r[0]: tuple(r)[1:] for r in window_index.substring_dedup(df).collect()}
    assert got == {i: v[:3] for i, v in brute_windows(texts).items()}
    assert window_index.substring_dedup(no_docs).count() == 0


def test_index_goes_on_in_tiers_and_another_session(spark, odd_docs):
    """Batches appended one by one, with the index opened anew each time, give what one pass over all gives."""
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    want = {i: v[:3] for i, v in brute_windows(texts).items()}
    ids = sorted(texts)
    first = window_index.WindowIndex(spark, buckets=3)
    path, got, tiers = first.path, {}, []
    first.close()
    for k in range(0, len(ids), 3):
        index = window_index.WindowIndex(spark, path, buckets=3)
        batch = odd_docs.filter(odd_docs.doc_id.isin(ids[k : k + 3]))
        out = window_index.substring_dedup(batch, batches=1, index=index, history=odd_docs.filter(odd_docs.doc_id.isin(ids[:k])))
        got |= {r[0]: tuple(r)[1:] for r in out.collect()}
        tiers.append(sorted(t for t, *_ in index.runs))
        index.close()
    assert got == want
    assert tiers[:4] == [[0], [1], [0, 1], [2]] and all(len(set(t)) == len(t) for t in tiers)
    rebuilt = {r[0]: tuple(r)[1:] for r in window_index.substring_dedup(odd_docs, batches=1).collect()}
    assert rebuilt == got
    with pytest.raises(ValueError):
        window_index.WindowIndex(spark, path, width=20)
    window_index.WindowIndex(spark, path, buckets=3).close(delete=True)
    assert window_index.WindowIndex(spark, path).runs == []


def test_windows_of_repeated_ids(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(120)) for _ in range(2))
    df = spark.createDataFrame([(1, a, 1), (1, b, 2), (1, a, 3), (2, a, 4), (2, b + " end", 5), (3, "x " + a, 6)], "doc_id long, text string, tk long")
    for batches in (1, 3):
        got = sorted((r[0], r[1], r[2]) for r in window_index.substring_dedup(df, batches=batches).collect())
        assert got == [(1, 120, 0), (1, 120, 0), (1, 120, 0), (2, 120, 120), (2, 121, 120), (3, 121, 120)]


def brute_bytes(texts, n=200):
    b = {i: (t or "").encode() for i, t in texts.items()}
    c = Counter(x[k : k + n] for x in b.values() for k in range(len(x) - n + 1))
    out = {}
    for i, x in b.items():
        edge = np.zeros(len(x) + 1, int)
        for k in range(len(x) - n + 1):
            if c[x[k : k + n]] > 1:
                edge[k] += 1
                edge[k + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[i] = (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_bytes_on_odd_rows(odd_docs, hot):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    got = {r[0]: (*tuple(r)[1:-1], bytes(r[-1])) for r in phrase_dedup.repeated_bytes(odd_docs, hot=hot, with_bytes=True).collect()}
    assert got == brute_bytes(texts)


@pytest.fixture(scope="module")
def framed(spark):
    """Passages of 150 to 700 bytes in many documents, each time with other surroundings that partly agree, and runs of one letter."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages, frames = [text(n) for n in (150, 199, 200, 201, 260, 700)], [text(30) for _ in range(6)]
    rows = []
    for i in range(240):
        p = passages[i % 6]
        left, right = frames[rng.randrange(6)][rng.randrange(30) :], frames[rng.randrange(6)][: rng.randrange(30)]
        rows.append((i, text(rng.randrange(200)) + left + p + right + text(rng.randrange(200))))
    rows += [(900 + i, text(20) + "z" * (300 + 7 * i) + text(20)) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("hot", [2000, 20, 1])
def test_repeated_bytes_of_hot_triggers(framed, hot):
    texts = {r["doc_id"]: r["text"] for r in framed.collect()}
    got = {r[0]: (*tuple(r)[1:-1], bytes(r[-1])) for r in phrase_dedup.repeated_bytes(framed, hot=hot, with_bytes=True).collect()}
    assert got == brute_bytes(texts)


def test_repeated_bytes_on_the_table(spark, sf, no_docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r[0]: tuple(r)[1:] for r in phrase_dedup.repeated_bytes(df).collect()}
    assert got == {i: v[:4] for i, v in brute_bytes(texts).items()}
    assert phrase_dedup.repeated_bytes(no_docs).count() == 0


def test_suffix_ranks_equal_windows():
    rng = random.Random(0)
    entries = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (40, 41, 5, 60)]
    off = np.cumsum([0, *map(len, entries)])
    start, rank = phrase_dedup.suffix_ranks(np.frombuffer(b"".join(entries), np.uint8), off, 20)
    whole = b"".join(entries)
    order = {}
    for s, r in zip(start, rank, strict=True):
        order.setdefault(int(r), set()).add(whole[s : s + 20])
    assert all(len(v) == 1 for v in order.values()) and len({next(iter(v)) for v in order.values()}) == len(order)
    assert [next(iter(order[r])) for r in sorted(order)] == sorted(next(iter(v)) for v in order.values())


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    least, count = {}, Counter(t for _, t in norm)
    for i, t in norm:
        least[t] = min(i, least.get(t, i))
    return sorted((i, least[t], count[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


@pytest.mark.parametrize("budget", [64 << 20, 2000])
def test_exact_with_and_without_spilling(odd_docs, no_docs, budget):
    twice = odd_docs.union(odd_docs.filter("doc_id > 95"))  # repeated rows
    got = exact_dedup.exact_dedup(twice, budget=budget).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact([(r["doc_id"], r["text"]) for r in twice.collect()])
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])
    stay = exact_dedup.drop_exact_duplicates(twice, budget=budget)
    assert stay.columns == twice.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted(kept)
    assert {(r["doc_id"], r["text"], r["n"], r["uid"]) for r in stay.collect()} <= {(r["doc_id"], r["text"], r["n"], r["uid"]) for r in twice.collect()}
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def test_exact_with_salted_hashes(spark, odd_docs, monkeypatch):
    """Copies in very many batches, as more cells than one; the budget makes cells spill, too."""
    monkeypatch.setattr(exact_dedup, "CELL", 3)
    rows = [(1000 - i, "same  text" if i % 2 else "same\ttext" if i % 4 else f"other {i % 12}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid long").repartition(40).union(odd_docs.select("doc_id", "text", "uid"))
    for budget in (64 << 20, 300):
        got = exact_dedup.exact_dedup(df, budget=budget).collect()
        want = brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        kept = sorted(r["doc_id"] for r in got if r["kept"])
        assert kept == sorted({w[1] for w in want}) and sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df, budget=budget).collect()) == kept


def test_open_table_compares_contents(tmp_path):
    t = exact_dedup.OpenTable(4)
    seen = [t.find(7, bytes([i % 50])) for i in range(200)]  # one hash for all
    assert [e for e, _ in seen] == [i % 50 for i in range(200)] and sum(new for _, new in seen) == 50
    rows = [(5, [i], (i, i), 1, b"%d" % (i % 90)) for i in range(300)]
    groups = list(exact_dedup.grace_groups(rows, 500, str(tmp_path)))
    assert sorted(len(m) for m, *_ in groups) == sorted(Counter(i % 90 for i in range(300)).values())


def test_rows_without_id_are_left_out(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert minhash.near_dedup(df).count() == exact_dedup.exact_dedup(df).count() == window_index.substring_dedup(df).count() == phrase_dedup.repeated_bytes(df).count() == 2


def test_repeated_ids(spark, odd_docs):
    """Rows that repeat id and text: each gets its row, equal to the others; with other texts nothing fails and no row is lost."""
    same = odd_docs.union(odd_docs.filter("doc_id > 85"))
    other = odd_docs.union(odd_docs.select("doc_id", "n", "n", "uid", "id").toDF(*odd_docs.columns))
    for run in (minhash.near_dedup, window_index.substring_dedup):
        single = {tuple(r) for r in run(odd_docs).collect()}
        got = [tuple(r) for r in run(same).collect()]
        assert len(got) == same.count() and set(got) == single
        assert run(other).count() == other.count()
    for df in (same, other):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = brute_bytes({(i, k): t for k, (i, t) in enumerate(texts)})
        assert sorted(tuple(r) for r in phrase_dedup.repeated_bytes(df).collect()) == sorted((i, *v[:4]) for (i, _), v in want.items())


def test_words_and_chunks_agree_with_python(odd_docs):
    import pyarrow as pa

    texts = [r["text"] for r in odd_docs.collect()]
    col = pa.array(texts)
    for limit in (50, 1 << 20):
        for i, j, raw, off in textkit.parts(col, limit):
            w = textkit.Words(raw, off)
            for k in range(j - i):
                own = slice(w.off[k], w.off[k + 1])
                assert [bytes(raw[a:b]).decode() for a, b in zip(w.start[own], w.end[own], strict=True)] == words(texts[i + k])


def test_components_of_chains_and_stars(spark):
    from factloom.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
