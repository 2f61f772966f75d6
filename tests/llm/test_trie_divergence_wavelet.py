"""Operators 11 to 13 against SQL and plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.compare import rows

from factloom.llm import conversation_trie, divergence, registry, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_source_divergence"])
def test_query_equals_sql(name, spark, sf, duck):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# --- prefix trie


def _plain_trie(turns):
    """turns: (conv, turn, role, text) -> set of node rows."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(cs), len(k), min(members[k[:-1]]) if k else -1, len(cs), kids[k], leaves[k], saved[k], sha([c for c in cs if len(full[c]) == len(k)])) for k, cs in members.items())


def _trie(df, **kw):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in conversation_trie.prefix_trie(df, **kw).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [1, 4096])
def test_trie_equals_brute_force(spark, local):
    """Copies, shared starts, one conversation with a third of all turns, ties and repeats, null and blank fields, gaps in ids."""
    rng = random.Random(7)
    turns = []
    for c in [*range(0, 90, 2), 101, 140, 141, 142]:
        same = c % 5 == 0
        for t in range(3 if same else rng.randint(1, 5)):
            turns.append((c, t, "user" if t % 2 else None, "same text" if same or t < 1 else rng.choice(["a b", "a  b", None, "", "c\n d é"])))
    turns += [(60, 100 + t, "user", f"turn {t % 7}") for t in range(80)] + [(80, None, "system", "first of all"), (80, None, "system", "first of all"), (82, 1, "x", "b"), (82, 1, "x", "a"), (None, 1, "x", "lost")]
    df = spark.createDataFrame(turns, SCHEMA).withColumns({"tid": F.lit("x"), "words": F.lit(None).cast("string"), "b": F.lit(3)})
    assert _trie(df.repartition(3), local=local) == _plain_trie(turns)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.prefix_trie(none).collect() == []
    turns = [(c, 0, "user", "x") for c in range(1, 20)]  # no conversation 0, so those with h > 0 lose their turn
    assert _trie(spark.createDataFrame(turns, SCHEMA)) == _plain_trie(turns)
    assert all(n[1] == 0 or n[1] == 1 for n in _plain_trie(turns))


@given(st.lists(st.lists(st.integers(0, 3), max_size=5), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_multikey_quicksort_equals_prefix_sets(seqs):
    lens = np.array([len(s) for s in seqs])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    flat = np.array([x for s in seqs for x in s], np.int64)
    convs = np.arange(len(seqs))[::-1].copy()
    got = conversation_trie.multikey_nodes(2, 5, 1, convs, starts, lens, flat, flat)
    members = defaultdict(list)
    for c, s in zip(convs.tolist(), seqs, strict=True):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    want = sorted((min(cs), 2 + len(k), min(members[k[:-1]]) if k else 5, len(cs)) for k, cs in members.items())
    assert sorted(n[:4] for n in got) == want


# --- divergence


def _plain_divergence(docs, least):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(low))
        counts[lang, source].update(found)
        seen[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        v = len(kept)
        share = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            n = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-f(share[s][t], share[None][t]), t.encode(), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            out += [(lang, s, "pair", o, -x, k) for k, (x, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -x, k) for k, (x, _, t) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("light,tile", [(8, 1024), (1, 2), (3, 1), (100, 5)])
def test_divergence_equals_brute_force(spark, monkeypatch, light, tile):
    """Nulls, blanks, groups without terms, a language without kept terms, one source with a third of all rows, more groups than a tile has."""
    monkeypatch.setattr(divergence, "TERMS", tile)
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "STRETCH", 50)
    rng = random.Random(3)
    vocab = ["Alpha", "béta", "日本", "c", "D", "gamma7delta", "e'f", "x_y"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [("en", "hot" if i % 3 == 0 else f"s{rng.randint(0, 8)}", " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(160)]
    docs += [("fr", f"t{i}", "rare words " * i) for i in range(3)] + [(None, None, None), ("", "z", ""), ("en", None, "   "), ("en", "hot", " ".join(["alpha"] * 300)), ("de", "only", "x")] + [("en", "empty", None)] * 4
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({"term": F.lit(1), "g": F.lit("x"), "n": F.lit(None).cast("int")})
    got = sorted(map(tuple, divergence.divergence(df.repartition(3), least=4, light=light).collect()))
    assert got == _plain_divergence(docs, 4) and any(r[2] == "term" for r in got)


def test_divergence_of_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3)})
    plain = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, divergence.divergence(docs, least=2).collect())) == _plain_divergence(plain, 2)
    assert divergence.divergence(no_docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect() == []


# --- wavelet files


@given(st.lists(st.integers(0, 70_000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix_equals_a_list(ids):
    shard = wavelet.Shard(pa.BufferReader(wavelet.pack(np.array(ids, np.uint32), np.array([3]), np.array([len(ids)]))))
    assert shard.all().tolist() == ids and [shard.access(i) for i in range(len(ids))] == ids
    for t in [*ids[:5], 0, 5, 1 << 20]:
        assert list(shard.locate(t)) == [i for i, x in enumerate(ids) if x == t]
        assert shard.count(t, len(ids) // 3, len(ids) - len(ids) // 4) == ids[len(ids) // 3 : len(ids) - len(ids) // 4].count(t)


def test_long_wavelet_matrix_is_compressed_and_read_in_blocks():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 400_000) % 50_000).astype(np.uint32)
    data = wavelet.pack(ids, np.array([1, 9]), np.array([150_000, 250_000]))
    assert len(data) < 0.95 * 2 * len(ids)

    class Counting:
        def __init__(self, raw):
            self.raw, self.at, self.read_bytes = raw, 0, 0

        def seek(self, to, how=0):
            self.at = len(self.raw) + to if how == 2 else to
            return self.at

        def read(self, n):
            out = self.raw[self.at : self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

    file = Counting(data)
    shard = wavelet.Shard(file)
    opened = file.read_bytes
    assert [shard.access(i) for i in (0, 399_999, 123_456)] == ids[[0, 399_999, 123_456]].tolist()
    assert shard.count(1) == int((ids == 1).sum()) and shard.count(7, 1000, 300_000) == int((ids[1000:300_000] == 7).sum())
    assert file.read_bytes - opened < len(data) / 2
    assert list(shard.locate(40_000)) == np.flatnonzero(ids == 40_000).tolist() and (shard.all() == ids).all()
    with pytest.raises(ValueError):
        wavelet.Shard(pa.BufferReader(b"something else, and long enough"))
    with pytest.raises(IndexError):
        shard.access(400_000)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wavelet.default_vocabulary())


SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎   ​    　﻿"


@given(st.lists(st.sampled_from([*SPACES, *"ab1'!é日", "  ", "<|endoftext|>", " the", "'ve", "\x00"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_like_the_whole(tokenizer, parts):
    text = "".join(parts)
    encode = wavelet.Encoder(wavelet.default_vocabulary()) if not hasattr(test_pieces_encode_like_the_whole, "e") else test_pieces_encode_like_the_whole.e
    test_pieces_encode_like_the_whole.e = encode
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_batches_and_what_is_remembered(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "REMEMBERED", 30)
    monkeypatch.setattr(wavelet, "LONGEST", 12)
    encode = wavelet.Encoder(wavelet.default_vocabulary())
    rng = random.Random(6)
    for _ in range(60):
        texts = ["".join(rng.choice(["word ", "x" * 35, "  \n y", "\n\n  a", " ", "é 日本 ", "\u3000 ", "the", "\xa0", ".\t", ""]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        raw = [t.encode() for t in texts]
        ids, counts = encode.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_equal_hashes_of_other_pieces_do_no_harm(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet.T, "mix", lambda x: x & np.uint64(3))
    encode = wavelet.Encoder(wavelet.default_vocabulary())
    for text in ("all of these share a few hashes", "these all of few a share hashes", "and other ones besides"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def _want(docs, tokenizer):
    start, out = 0, []
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query_equals_plain_encoding(spark, sf, tokenizer):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, registry.QUERIES["op13_token_files"](spark, sf).collect())) == _want(docs, tokenizer)


def test_token_files_of_odd_rows(spark, odd_docs, no_docs, tokenizer, tmp_path):
    texts = sorted((r["doc_id"], r["text"]) for r in odd_docs.collect())
    for shard in (300, 1 << 20):
        where = f"file://{tmp_path}/{shard}"
        made = wavelet.write_tokens(odd_docs.union(odd_docs.limit(0)), where, shard=shard)
        assert made.count() > 3 or shard > 300
        assert sorted(map(tuple, wavelet.read_digests(spark, where).collect())) == _want(texts, tokenizer)
        ids = {r["doc_id"]: r["ids"] for r in wavelet.read_tokens(spark, where).collect()}
        assert ids == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
        asked = [0, 397, 50_000, 99_999]
        counts = {r["token"]: r["n"] for r in wavelet.token_counts(spark, where, asked).collect()}
        assert counts == {t: sum(x.count(t) for x in ids.values()) for t in asked}
        found = {tuple(r) for r in wavelet.occurrences(spark, where, asked).collect()}
        assert found == {(t, i, p) for i, x in ids.items() for p, t in enumerate(x) if t in asked}
    # a null id is left out, rows that repeat an id stand one after another
    twice = odd_docs.union(odd_docs).union(odd_docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = wavelet.token_files(twice).collect()
    assert len(got) == 2 * len(texts) and sum(r["n_tokens"] for r in got) == 2 * sum(map(len, ids.values()))
    assert sorted(r["start"] for r in got)[0] == 0 and len({r["start"] for r in got}) == len(got)
    assert wavelet.token_files(no_docs).collect() == []


def test_unlisted_files_are_not_read(spark, odd_docs, tmp_path):
    where = f"file://{tmp_path}/t"
    wavelet.write_tokens(odd_docs, where)
    before = sorted(map(tuple, wavelet.read_digests(spark, where).collect()))
    (tmp_path / "t" / "0000000-00000-of-a-lost-attempt.wm").write_bytes(b"half")
    assert sorted(map(tuple, wavelet.read_digests(spark, where).collect())) == before
