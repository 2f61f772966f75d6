"""Quality, toxicity, decontamination, subword pieces, url filters, HTML and the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, html_text, pieces, quality, registry, toxicity, url_filter
from factloom.llm import labelled as labelled_rows

RULES = registry.URL_RULES


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents with a learnable quality and toxicity: noise lines are bad, some words are toxic."""
    rng = random.Random(11)
    syllables = ["an", "re", "ti", "on", "the", "er", "in", "ou", "st", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["zorblax", "krungor", "vexwump", "qyzzick"]
    docs, labels = [], []
    for i in range(700):
        lines = [" ".join(word() for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            lines = [" ".join(w if rng.random() > 0.2 else rng.choice(bad) for w in s.split()) + " " + rng.choice(bad) for s in lines]
        good = i % 4 != 1
        if not good:
            lines = [" ".join(w.upper() + "!!" for w in s.split()) if rng.random() < 0.9 else s for s in lines]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, label, mod, held, least", [(quality.quality, "quality", 5, 0, 0.95), (toxicity.toxicity, "toxic", 4, 2, 0.95)])
def test_held_out_accuracy(labelled, operator, label, mod, held, least):
    docs, labels = labelled
    rows = operator(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 700 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == held) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert len(test) > 100 and np.mean([r["predicted"] == r[label] for r in test]) >= least


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_scores_of_odd_rows_and_without_labels(labelled, odd_docs, no_docs, operator):
    docs, labels = labelled
    names = {"doc_id", "held_out", "score", "predicted"}
    got = operator(odd_docs.select("doc_id", "text", "n"), labels.withColumn("doc_id", F.col("doc_id") - 1000))
    assert set(got.columns) == names and all(r["score"] == got.first()["score"] for r in got.collect())
    shifted = odd_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").union(docs)
    assert all(0 <= r["score"] <= 1 for r in operator(shifted, labels).collect())
    assert operator(no_docs, labels.limit(0)).count() == 0


def test_held_out_labels_are_never_used(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def _plain_windows(text):
    """The operator's windows, cut by hand."""
    flat = " " + " ".join("".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text).split(" ")) + " "
    flat = " ".join(flat.encode().decode().split(" "))
    words = [w.encode() for w in flat.split(" ") if w]
    flat = b" " + b" ".join(words) + b" "
    out, i = [], 0
    while i < len(flat) - 1:
        piece = flat[i : i + 48]
        if i + 48 < len(flat) and b" " in piece[1:]:
            piece = piece[: piece.rindex(b" ", 1) + 1]
        out.append(piece)
        if i + len(piece) >= len(flat):
            break
        i += len(piece) - piece.endswith(b" ")
    return out


def test_toxicity_query_equals_plain_compression(spark, sf):
    """Scores of the query, from the fitted dictionaries and weights by hand: every window compressed by itself."""
    import zstandard as z

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    options = lambda: z.ZstdCompressionParameters(strategy=z.STRATEGY_BTLAZY2, min_match=5, window_log=19, hash_log=17, chain_log=18, search_log=8, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain, toxic = (z.ZstdCompressor(compression_params=options(), dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT)) for c in (model.distance.ordinary, model.distance.toxic))
    assert len(model.distance.ordinary) == len(model.distance.toxic)
    c = model.calibrate
    for r in registry.QUERIES["op5_toxicity"](spark, sf).collect():
        gains = sorted((len(plain.compress(w)) - len(toxic.compress(w)) for w in _plain_windows(texts[r["doc_id"]])), reverse=True)
        two, four = sum(g >= 2 for g in gains), sum(g >= 4 for g in gains)
        x = (max(gains[0], 0), max(sum(gains[:3]), 0), math.log1p(two), math.log1p(four), two / len(gains), math.log1p(len(gains))) if gains else (0.0,) * 6
        logit = c.w[0] + sum(w * (v - m) / s for w, v, m, s in zip(c.w[1:], x, c.mean, c.scale, strict=True))
        want = 1 / (1 + math.exp(-max(-30, min(30, logit))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def _plain_line(line, text_lines):
    """Sixteen features of one line, written out."""
    raw = line.encode()
    size = max(len(raw), 1)
    classes = [(65, 91), (97, 123), (48, 58)]
    shares = [sum(a <= b < z for b in raw) / size for a, z in classes]
    shares += [sum(chr(b) in chars for b in raw) / size for chars in ("#$%&*|<>{}[]=~^\\_@", "!", ".?", ",;:")] + [sum(b >= 128 for b in raw) / size]
    words = [w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    n = max(len(words), 1)
    by = [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(len(w) <= 3 for w in words) / n, sum(chr(w[-1]) in "#$%&*|<>{}[]=~^\\_@!" for w in words) / n, sum(65 <= w[0] < 91 for w in words) / n]
    span = 0
    if words:
        first = raw.index(words[0])
        span = raw.rindex(words[-1]) + len(words[-1]) - first
    bag = lambda x: sorted(w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", x.encode()) if w)
    again = sum(bag(x) == bag(line) for x in text_lines) - 1
    return [*shares, *by, math.log1p(size) / 5, math.log1p(len(words)) / 5, min(span / n, 40) / 10, min(again, 5) / 5], (len(raw) if words else 0)


def test_quality_query_equals_a_plain_field(spark, sf):
    """Scores of the query from the fitted weights: features, forward and backward sums and the weighted mean by hand, line by line."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    e = np.exp(model.trans)
    for r in registry.QUERIES["op3_quality_classifier"](spark, sf).collect():
        text = texts[r["doc_id"]]
        lines = text.splitlines(keepends=True) if text and not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else None
        if lines is None:
            continue
        made = [_plain_line(x, lines) for x in lines]
        z = [(np.array(f) - model.mean) / model.scale for f, _ in made]
        none = np.zeros(quality.N_FEATURES)
        rows = [np.concatenate([z[i], z[i - 1] if i else none, z[i + 1] if i + 1 < len(z) else none, [1.0]]) for i in range(len(z))]
        psi = [np.exp(x @ model.w - (x @ model.w).max()) for x in rows]
        fwd, bwd = [psi[0]], [np.ones(2)]
        for p in psi[1:]:
            f = (fwd[-1] @ e) * p
            fwd.append(f / f.sum())
        for p in psi[:0:-1]:
            b = e @ (p * bwd[-1])
            bwd.append(b / b.sum())
        good = [f[1] * b[1] / (f * b).sum() for f, b in zip(fwd, bwd[::-1], strict=True)]
        mass = sum(w for _, w in made)
        if not mass:
            continue
        x = [sum(w * g for g, (_, w) in zip(good, made, strict=True)) / mass, sum(w for g, (_, w) in zip(good, made, strict=True) if g < 0.5) / mass, math.log1p(mass), 1.0]
        c = model.calibrate
        logit = c.w[0] + sum(w * (v - m) / s for w, v, m, s in zip(c.w[1:], x, c.mean, c.scale, strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, logit))))) < 1e-6


def test_repeated_rows_and_long_texts_in_classifiers(labelled, spark):
    docs, labels = labelled
    long = spark.createDataFrame([(5000, "an re ti " * 40_000), (5000, "an re ti " * 40_000), (5001, "zorblax\n" * 30_000)], "doc_id long, text string")
    more = labels.union(spark.createDataFrame([(5000, 1, 0), (5000, 1, 0), (5001, 0, 1)], labels.schema))
    for operator, score in ((quality.quality, "quality"), (toxicity.toxicity, "toxic")):
        rows = operator(docs.union(long), more).filter("doc_id >= 5000").collect()
        assert len(rows) == 3 and len({r["score"] for r in rows if r["doc_id"] == 5000}) == 1
    from factloom.llm import labelled as lab

    got = lab.sample(docs.union(long), more, "toxic", 4, 2, (6000, 1500), stretch=100)
    assert all(len(t) <= 100 for _, t, _ in got) and {i for i, _, _ in got} >= {i for i in (5000, 5001) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_all_stretches_of_a_long_text_are_learned_from(spark):
    """A word that stands only at the end of long labelled texts counts, and a long text's rows are all of it."""
    rng = random.Random(2)
    plain = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "words", "of", "every", "day"]) for _ in range(n))
    rows = [(i, plain(40_000) + " zorblax krungor" * 30 if i % 2 else plain(300), i % 2) for i in range(40)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = labelled_rows.sample(docs, labels, "toxic", 4, 2, (500, 500))
    parts = {}
    for i, text, _ in got:
        parts.setdefault(i, []).append(text)
    kept = {i: t for i, t, _ in rows if i in parts}
    assert all(sorted(parts[i]) == sorted(t[a : a + labelled_rows.STRETCH] for a in range(0, len(t), labelled_rows.STRETCH)) for i, t in kept.items())
    assert max(map(len, parts.values())) > 3 and len(labelled_rows.sample(docs, labels, "toxic", 4, 2, (5, 7))) == 12
    tests = spark.createDataFrame([(100, plain(300) + " zorblax krungor" * 3), (101, plain(300))], "doc_id long, text string")
    score = {r["id"]: r["score"] for r in toxicity.scored_by(toxicity.fit(docs, labels), tests, "doc_id", "text").collect()}
    assert score[100] > score[101]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([0, 3, 3, 4, 9])
    potential, trans = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    got, pairs = quality.forward_backward(potential, lines, trans)
    want, want_pairs = np.zeros_like(got), np.zeros((2, 2))
    for a, z in zip(lines[:-1], lines[1:], strict=True):
        paths = {}
        for bits in range(2 ** (z - a)):
            y = [bits >> k & 1 for k in range(z - a)]
            paths[tuple(y)] = math.exp(sum(potential[a + k, v] for k, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False)))
        total = sum(paths.values())
        for y, w in paths.items():
            for k, v in enumerate(y):
                want[a + k, v] += w / total
            for u, v in zip(y, y[1:], strict=False):
                want_pairs[u, v] += w / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_windows_cover_all_bytes():
    for text in ("", "a", "one two three " * 30, "x" * 400, "é" * 99, "a b " + "y" * 60 + " c"):
        flat = toxicity.flatten(text)
        ws = toxicity.windows(flat)
        joined = b""
        for w in ws:
            assert 0 < len(w) <= toxicity.WINDOW + 1
            joined += w[1:] if joined.endswith(b" ") and w.startswith(b" ") else w
        assert not ws or joined == flat


def test_two_dictionaries_differ_only_where_toxic_stretches_match():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on"]) for _ in range(3))
    plain = [" ".join(word() for _ in range(80)) for _ in range(60)]
    toxic = [p + " zorblax krungor " + p[:30] + " zorblax " + p[31:60] + " krungor" for p in plain[:30]]
    d = toxicity.Distance(*toxicity.contents([toxicity.flatten(t) for t in toxic], [toxicity.flatten(t) for t in plain[30:]]))
    assert d.features("some zorblax here")[0] >= 3 and d.features(plain[40])[0] <= 1


# --- decontamination


def test_masks_find_two_substitutions_in_thirteen_words():
    import itertools

    for bad in itertools.combinations(range(13), 2):
        places = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
        assert any(all(s + p not in bad for p in pl) for pl in places for s in range(13 - pl[-1]))


@pytest.mark.parametrize("small", [10**6, 0])
def test_leaks_equal_brute_force(spark, small):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (40, 25, 13, 11, 6, 3, 30)]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            item = items[i % len(items)]
            part = item[:] if i % 2 else item[: max(13, len(item) // 2)]
            for _ in range(i % 4):
                part[rng.randrange(len(part))] = "sub"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs.append((99, None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None)], "item_id long, text string")

    def brute(text):
        d, found = (text or "").lower().split(), []
        for k, item in enumerate(items):
            n = min(13, len(item))
            if len(item) < 5:
                continue
            need = len(item) if len(item) < min(map(len, decontaminate.MASKS)) else 0.8 * n
            best = max((sum(d[p + q] == item[q0 + q] for q in range(n)) for q0 in range(len(item) - n + 1) for p in range(len(d) - n + 1)), default=0)
            if best >= need:
                found.append(k)
        return found

    got = {r["doc_id"]: r for r in decontaminate.find_leaks(df, tests, small=small).collect()}
    for i, text in docs:
        want = brute(text)
        assert got[i]["item_ids"] == want and got[i]["contaminated"] == bool(want)
    assert sorted(decontaminate.drop_leaks(df, tests).columns) == sorted(df.columns)
    assert not decontaminate.find_leaks(df, tests.limit(0)).filter("contaminated").count()


def _substituted(spark, lengths, small):
    """(doc, item, tolerated) rows: an item of each length under all sets of up to three substitutions, in other words."""
    import itertools

    docs, want, items = [], {}, {n: [f"w{n}x{q}" for q in range(n)] for n in lengths}
    for n, item in items.items():
        least = n if n < 9 else 0.8 * n
        for k in range(4):
            for bad in itertools.combinations(range(n), k):
                want[len(docs)] = [n] if n - k >= least else []
                docs.append((len(docs), " ".join(["a"] * (len(docs) % 5) + ["sub" if q in bad else w for q, w in enumerate(item)] + ["z", "z"])))
    tests = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), tests, small=small).collect()
    return {r["doc_id"]: r["item_ids"] for r in found}, want


@pytest.mark.parametrize("small", [10**6, 0])
def test_every_tolerated_substitution_is_found_at_each_length(spark, small):
    got, want = _substituted(spark, range(9, 14), small)
    assert got == want


@pytest.mark.parametrize("small", [10**6, 0])
def test_short_items_match_as_a_whole_whatever_the_size(spark, small):
    got, want = _substituted(spark, range(4, 9), small)
    assert got == {i: [n for n in w if n >= decontaminate.LEAST] for i, w in want.items()} and any(got.values())


@pytest.mark.parametrize("small", [10**6, 0])
def test_rows_that_share_an_id_are_judged_apart(spark, small):
    """Items of one id with other texts each count; documents of one id are judged by their own texts."""
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "pq")
    docs = spark.createDataFrame([(1, f"x {a} y {b} z"), (2, a), (2, "clean " * 30), (3, b), (4, " ".join([a] * 40)), (5, "clean")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, a), (9, b), (9, b), (10, b + " more words after it")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_ids"]) for r in decontaminate.find_leaks(docs, tests, small=small).collect())
    assert got == [(1, [9, 10]), (2, []), (2, [9]), (3, [9, 10]), (4, [9]), (5, [])]


@pytest.mark.parametrize("small", [10**6, 0])
def test_leaks_in_odd_rows(spark, odd_docs, no_docs, small):
    """Repeated rows and items, nulls, very long texts, columns of other meanings."""
    text = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    long = next(t for t in text.values() if len(t) > 100_000).split()
    passage = " ".join(long[20_000:20_040])
    tests = spark.createDataFrame([(1, passage.upper(), "t"), (1, passage.upper(), "t"), (2, "x", "t"), (3, None, None), (None, passage, "t"), (4, " ".join(["ab"] * 30), "t")], "item_id long, text string, doc_id string")
    twice = odd_docs.withColumns({"item": F.lit(7), "seed": F.lit("s"), "item_ids": F.lit(1)}).union(odd_docs.withColumns({"item": F.lit(7), "seed": F.lit("s"), "item_ids": F.lit(1)}))
    out = decontaminate.find_leaks(twice, tests, small=small)
    want = sorted((i, ([1] if passage in t else []) + ([4] if t.startswith("ab ab") else [])) for i, t in text.items() for _ in range(2))
    assert sorted((r["doc_id"], r["item_ids"]) for r in out.collect()) == want and any(x for _, x in want)
    kept = decontaminate.drop_leaks(twice, tests)
    assert kept.columns == twice.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in want if not x]
    assert decontaminate.find_leaks(no_docs, tests, small=small).count() == 0


# --- pieces


def _plain_segmentation(sp, known, vocab, text, key):
    """Forward filtering and backward sampling of one text, written out, with the operator's draws."""
    if not text:
        return []
    code = ["\x00own" if c == "▁" else "▁" if c == " " else c for c in text]
    code = ["▁", *code]
    have = {c for w in known for c in w}
    bare = [c not in have for c in code]
    cuts = [0, *(i for i in range(1, len(code)) if (code[i] == "▁" and code[i - 1] != "▁") or bare[i] or bare[i - 1]), len(code)]
    out = []
    for number, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        unit, n = code[a:z], z - a
        edges = [[] for _ in range(n + 1)]
        for e in range(1, n + 1):
            for size in range(1, min(e, vocab.longest) + 1):
                word = "".join(unit[e - size : e])
                if word in known and "\x00own" not in unit[e - size : e]:
                    edges[e].append((e - size, [known[word]], vocab.weight[known[word]]))
                elif size == 1:
                    spelled = [vocab.byte_id[x] for x in ("▁" if unit[e - 1] == "\x00own" else unit[e - 1]).encode()]
                    edges[e].append((e - 1, spelled, len(spelled) * vocab.weight[vocab.byte_id[0]]))
        score = [0.0] + [None] * n
        for e in range(1, n + 1):
            score[e] = np.logaddexp.reduce([score[s] + w for s, _, w in edges[e] if score[s] is not None])
        at, step, picked = n, 0, []
        while at > 0:
            u = pieces.draw(0, key, np.array([number]), step)[0]
            order = sorted(edges[at], key=lambda x: -x[0])
            cum = np.cumsum([math.exp(score[s] + w - score[at]) for s, _, w in order])
            at, ids, _ = order[min(int(np.searchsorted(cum, u, "right")), len(order) - 1)]
            picked.append(ids)
            step += 1
        out += [int(i) for ids in picked[::-1] for i in ids]
    return out


def test_encoding_query_equals_plain_segmentation(spark, sf, vocab, odd_docs):
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_sentencepiece"](spark, sf).collect()}
    assert got.keys() == texts.keys() and all(r["lossless"] and r["text_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())
    for i in sorted(texts, key=lambda i: len(texts[i]))[:60]:
        want = _plain_segmentation(sp, known, vocab, texts[i], pieces._row_keys(np.array([i])))
        assert got[i]["n_pieces"] == len(want) and got[i]["pieces_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    few = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if len(r["text"] or "") < 3000}
    for r in pieces.sample_encode(odd_docs).collect():
        if r["doc_id"] in few:
            assert r["pieces"] == _plain_segmentation(sp, known, vocab, few[r["doc_id"]], pieces._row_keys(np.array([r["doc_id"]])))


def test_kept_columns_of_any_name(odd_docs):
    kept = pieces.decode(pieces.sample_encode(odd_docs, keep=("id", "n", "uid")), keep=("id", "n", "uid"))
    assert kept.columns == ["doc_id", "text", "id", "n", "uid"]
    assert {(r["doc_id"], r["n"], r["uid"]) for r in kept.collect()} == {(r["doc_id"], r["n"], r["uid"]) for r in odd_docs.collect()}
    with pytest.raises(ValueError):
        pieces.sample_encode(odd_docs.withColumnRenamed("n", "pieces"), keep=("pieces",))


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary()


def test_one_worker_a_task_encodes_and_decodes(spark, odd_docs):
    """Two Python steps in one plan hold two workers a task, and executors keep all four of them; what comes out is as in two steps."""
    import corpus_pipeline

    kept = odd_docs.withColumnRenamed("n", "n_chars")
    both = corpus_pipeline.sentencepiece(spark, kept, "")
    for df in (both, pieces.round_trip(spark, odd_docs)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    encoded = pieces.sample_encode(odd_docs, keep=("n",)).withColumn("n_pieces", F.size("pieces"))
    want = pieces.decode(encoded, keep=("n", "pieces", "n_pieces")).withColumnRenamed("n", "n_chars")
    assert both.columns == want.columns and sorted(map(repr, both.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        pieces.encode_decoded(odd_docs.withColumnRenamed("n", "pieces"), keep=("pieces",))


def test_round_trip_and_reproducible(spark, odd_docs, no_docs):
    got = pieces.round_trip(spark, odd_docs)
    assert got.filter("lossless").count() == odd_docs.count()
    a = {r["doc_id"]: r["pieces"] for r in pieces.sample_encode(odd_docs).collect()}
    b = {r["doc_id"]: r["pieces"] for r in pieces.sample_encode(odd_docs.repartition(3, "text")).collect()}
    assert a == b and a != {r["doc_id"]: r["pieces"] for r in pieces.sample_encode(odd_docs, seed=1).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(pieces.sample_encode(odd_docs)).collect()} == texts
    assert pieces.round_trip(spark, no_docs).count() == 0


def test_pieces_that_spell_nothing_are_replaced(spark):
    odd = spark.createDataFrame([(1, [3 + 0xFF]), (2, [10**6, -1, None]), (3, None), (4, []), (5, [3 + 0xC3, 3 + 0xA9]), (6, [3 + 0x20, 3 + 0x61, -5])], "doc_id long, pieces array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(odd).collect()}
    assert got == {1: "\ufffd", 2: "\ufffd" * 3, 3: "", 4: "", 5: "é", 6: "a\ufffd"}


def test_sampling_equals_a_plain_lattice(vocab):
    """The same draws through a lattice written out by hand give the same pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    word, keys = "▁reheating", pieces._row_keys(np.arange(40))
    n = len(word)
    edges = [[] for _ in range(n + 1)]
    for z in range(1, n + 1):
        for size in range(1, z + 1):  # shortest first, as the operator orders them
            if word[z - size : z] in known:
                edges[z].append((z - size, known[word[z - size : z]]))
    score = [0.0] + [None] * n
    for z in range(1, n + 1):
        score[z] = np.logaddexp.reduce([score[a] + vocab.weight[i] for a, i in edges[z]])
    for k in range(40):
        at, step, out = n, 0, []
        while at > 0:
            u = pieces.draw(0, keys[k : k + 1], np.zeros(1, np.int64), step)[0]
            order = sorted(edges[at], key=lambda e: -e[0])
            cum = np.cumsum([math.exp(score[a] + vocab.weight[i] - score[at]) for a, i in order])
            pick = min(int(np.searchsorted(cum, u, "right")), len(order) - 1)
            at, piece = order[pick]
            out.append(piece)
            step += 1
        ids, _ = pieces.encode_texts(vocab, [word[1:]], keys[k : k + 1])
        assert ids.tolist() == out[::-1]


def test_frequencies_follow_the_lattice(vocab):
    n = 6000
    ids, off = pieces.encode_texts(vocab, ["then"] * n, pieces._row_keys(np.arange(n)), alpha=0.3)
    seen = collections.Counter(tuple(ids[a:z].tolist()) for a, z in zip(off[:-1], off[1:], strict=True))
    weight = {p: math.exp(0.3 * sum(vocab.weight[i] for i in p)) for p in seen}
    total = sum(weight.values())
    assert sum((c - n * weight[p] / total) ** 2 / (n * weight[p] / total) for p, c in seen.items()) < 4 * len(seen) + 20


def test_two_choice_table():
    rng = random.Random(0)
    keys = {rng.getrandbits(64): i for i in range(20_000)}
    t = pieces.Table(keys)
    assert t.get(np.array(list(keys), np.uint64)).tolist() == list(keys.values())
    assert (t.get(np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64)) == -2).all()


# --- urls


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_rules_hosts_and_paths(spark):
    rows = [("https://A.Example.com/en/x?q#f", None), ("http://www.example.com/en/1", ""), ("http://x.net/es/", None), ("http://notnet/es/1", None), ("http://net?x=/es/", None), ("no scheme", None), (None, None), ("ftp://b.net/fr/a://c", None), ("http://q.com", None)]
    got = {r["page_id"]: r for r in url_filter.url_filter(_pages(spark, rows), RULES).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (got[1]["rule"], got[1]["verdict"]) == ("www.example.com/en/", "allow")
    assert got[2]["verdict"] == "block" and got[3]["rule"] is None and (got[4]["host"], got[4]["path"], got[4]["rule"]) == ("net", "", None)
    assert got[5]["host"] == got[6]["host"] == "" and got[6]["verdict"] == "allow"
    assert (got[7]["host"], got[7]["path"], got[7]["verdict"]) == ("b.net", "/fr/a://c", "block") and got[8]["rule"] is None


def test_blocks_spread_over_aliases_and_allows_win(spark):
    link = lambda u: f'<html><head><link href="{u}" rel="canonical"></head></html>'
    rows = [
        ("http://x.org/1", link("http://bad.net/es/1")), ("http://bad.net/es/1", ""), ("http://www.x.org/1/", ""), ("http://y.org/2", ""), ("http://y.org/3", '<meta http-equiv="refresh" content="0; url=http://y.org/2">'),
        ("http://z.org/1", link("http://bad.net/fr/9")), ("http://bad.net/fr/9", link("http://good.com/a")), ("http://good.com/a", ""), ("http://lone.org/", ""),
    ]
    redirects = spark.createDataFrame([("http://y.org/2", "http://bad.net/es/1"), (None, "x")], "src string, dst string")
    for rules in (RULES, spark.createDataFrame(RULES, "verdict string, host string, path string")):
        got = {r["page_id"]: (r["verdict"], r["via"]) for r in url_filter.url_filter(_pages(spark, rows), rules, redirects).collect()}
        assert got[0] == got[3] == got[4] == ("block", "alias") and got[1] == ("block", "rule")
        assert got[2] == ("allow", "default")  # looks like an alias, but no edge says so
        assert got[5] == ("allow", "alias") and got[6] == ("block", "rule") and got[7] == ("allow", "rule") and got[8] == ("allow", "default")


def test_targets_are_resolved_as_urls(spark):
    from urllib.parse import urljoin

    bases = ["http://a.org/x/y/z.html?q=1#f", "https://a.org", "http://a.org/"]
    targets = ["http://b.net/1", "//b.net/es/1", "/en/page", "page.html", "./p", "../p", "../../../p/", "/a/./b/../c", "a/..", ".", "..", "?k=2", "p?u=http://c.org/", "p#a/../b", "/p?x=/../y", "#top"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "base string, target string")
    for r in df.withColumn("got", url_filter.resolve(F.col("base"), F.col("target"))).collect():
        want = urljoin(r["base"], r["target"])
        assert r["got"].removesuffix("/") == want.removesuffix("/"), (r, want)
    none = spark.createDataFrame([("http://a.org/", "mailto:x@y"), ("http://a.org/", ""), ("no scheme", "p"), (None, "p"), ("http://a.org/", None)], "base string, target string")
    assert none.filter(url_filter.resolve(F.col("base"), F.col("target")).isNotNull()).count() == 0


def test_blocks_spread_over_relative_links(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        ("http://p.org/a/1", link("2")), ("http://p.org/a/2", '<meta http-equiv="refresh" content="0; url=/b">'), ("http://p.org/b", link("//bad.net/es/1")), ("http://bad.net/es/1", ""),
        ("http://r.org/c/d", ""), ("http://r.org/moved", link("http://bad.net/fr/1")), ("http://bad.net/fr/1", ""), ("http://s.org/1", '<base href="http://bad.net/es/"><link rel=canonical href=1>'), ("http://lone.org/1", link("/2")),
    ]
    redirects = spark.createDataFrame([("http://r.org/c/d", "../moved")], "src string, dst string")
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in url_filter.url_filter(_pages(spark, rows), RULES, redirects).collect()}
    assert all(got[i] == ("block", "alias") for i in (0, 1, 2, 4, 5, 7)) and got[3] == got[6] == ("block", "rule") and got[8] == ("allow", "default")


def test_every_edge_of_a_page_and_odd_tables(spark):
    bad = "http://bad.net/es/1"
    rows = [
        ("http://a.org/1", '<!-- <link rel=canonical href="http://bad.net/es/1"> --><script>"<link rel=canonical href=http://bad.net/es/1>"</script>'), ("http://b.org/1", f'<link rel=canonical href="/2"><link rel="shortlink canonical" href="{bad}">'), (bad, ""),
        ("HTTP://C.org:80/1#f", ""), ("http://d.org/1", "<link rel='canonical' href='http://bad.net/fr/?a=1&amp;b=2'>"), ("http://bad.net/fr/?a=1&b=2", ""), ("http://e.org/1", '<a data-href="x"><link rel="alternate" title=canonical href="http://bad.net/es/1">'),
        ("http://f.org/" + "long/" * 50_000, ""), ("http://f.org/" + "long/" * 50_000, ""), (None, None), (None, None),
    ]
    df = _pages(spark, rows).withColumns({"host": F.lit("x"), "verdict": F.lit("allow"), "_key": F.lit(1), "rule": F.lit("r"), "node": F.lit(2)})
    redirects = spark.createDataFrame([("http://c.org/1", bad), ("http://f.org/" + "long/" * 50_000, bad)], "src string, dst string")
    out = url_filter.url_filter(df.union(df.filter("page_id = 3")), RULES, redirects)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "via"]
    got = sorted((r["page_id"], r["verdict"], r["via"]) for r in out.collect())
    alias, rule, none = ("block", "alias"), ("block", "rule"), ("allow", "default")
    assert got == [(i, *v) for i, v in ((0, none), (1, alias), (2, rule), (3, alias), (3, alias), (4, alias), (5, rule), (6, none), (7, alias), (8, alias), (9, none), (10, none))]


def test_urls_without_a_host_are_no_nodes(spark):
    """One page's link says nothing about other pages without a url, nor does a redirect from or to such a url."""
    link = '<link rel=canonical href="http://x.net/es/a">'
    rows = [(None, link), (None, None), ("http://x.net/es/a", None), ("", None), ("", link), ("no scheme", link), ("http://y.org/1", None), ("http://y.org/" + "q" * 300_000, link)]
    redirects = spark.createDataFrame([("", "http://x.net/es/a"), ("http://y.org/1", ""), ("", "http://y.org/1"), ("no scheme", "http://x.net/es/a")], "src string, dst string")
    for table in (None, redirects):
        got = {r["page_id"]: (r["host"], r["verdict"], r["via"]) for r in url_filter.url_filter(_pages(spark, rows), RULES, table).collect()}
        assert got[2] == ("x.net", "block", "rule") and got[7] == ("y.org", "block", "alias") and got[6] == ("y.org", "allow", "default")
        assert all(got[i] == ("", "allow", "default") for i in (0, 1, 3, 4, 5))


def test_redirect_query_equals_sql(spark, sf, duck):
    got = {tuple(r) for r in registry.QUERIES["url_redirects"](spark, sf).collect()}
    assert got == set(duck.execute(registry.SQL["url_redirects"]).fetchall())
    assert {r[5] for r in got} >= {"rule", "alias"}


def test_many_rules_are_joined(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 2)
    pages = _pages(spark, [("https://A.Example.com/en/x", None), ("http://www.example.com/en/1", ""), ("http://x.net/es/", None), (None, None)])
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    a, b = (sorted(map(tuple, url_filter.url_filter(pages, r).collect())) for r in (RULES, table))
    assert a == b and url_filter.url_filter(pages.limit(0), table).count() == 0


def test_url_query_equals_sql(spark, sf, duck):
    got = {tuple(r) for r in registry.QUERIES["op7_url_filter"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got == set(duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({registry.SQL['op7_url_filter']})").fetchall())


# --- html


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b<br>c</div>", "a\nb\nc"), ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n         | value\nlong name | 1"), ("<pre> a\n  b</pre>", " a\n  b"), ("a <b>b</b>  c&amp;d &lt;", "a b c&d <"),
        ("<title>t</title><style>p{}</style><script>'</p>'</script>x<!-- c -->y", "xy"), ("<p hidden>a</p><p style='display: none'>b</p><span style=visibility:hidden>c</span>d", "d"),
        ("<p>unclosed <i>tag", "unclosed tag"), ("</p></div>x", "x"), ("1 < 2 <", "1 < 2 <"), ("<textarea>&lt;b&gt;</textarea>", "<b>"), ("", ""), (None, ""), ("<blockquote>q</blockquote>z", "  q\n\nz"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<table><caption>c</caption><tr><td>a</table>b", "c\na\n\nb"),
    ],
)
def test_rendering(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>e</table>", "a | b\n  | c\n  | e"),
        ("<table><tr><td>a<td rowspan='2' colspan=2>b<td>c<tr><td>d<td>e</table>", "a | b |  | c\nd |   |  | e"), ("<p Style='Display:None'>a</p><p HiDDen>b</p>c", "c"), ("<table><tr><td colSpan=2>a<td>b</table>", "a |  | b"),
        ("<table><tr><td>" + "x" * 300 + "<td>1<tr><td>y<td>2</table>", "x" * 300 + " | 1\ny" + " " * 299 + " | 2"), ("<p>" + "<b>" * 50 + "x</p>y", "x\n\ny"),
        ("<table><tr><td>" * 30 + "<p>a<p>b" + "</td><td>c</td></tr></table>" * 30, "a b" + " | c" * 30),
    ],
)
def test_tables_and_attributes(html, text):
    assert html_text.html_to_text(html) == text


def test_wide_tables_stay_within_a_multiple_of_their_text():
    page = "<table>" + "".join(f"<tr><td>{'x' * 200_000 if i == 0 else i}<td>b" for i in range(5_000)) + "</table>"
    text = html_text.html_to_text(page)
    assert len(text) < 20 * len(page) and text.split("\n")[1] == "1    | b" and text.split("\n")[4_999] == "4999 | b" and text.count("\n") == 4_999
    assert html_text.html_to_text("<table><tr><td>" * 3_000 + "x") == "x"


def test_page_rows_of_every_kind(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p>a", "u"), (3, "<p>a", "v"), (None, "b", "w"), (4, "<p>" + "long " * 300_000, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, ("long " * 300_000).strip())], key=str)
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_deep_and_broken_pages_do_not_fail():
    assert html_text.html_to_text("<div>" * 20_000 + "x") == "x"
    assert "x" in html_text.html_to_text("<table><tr><td>" * 60 + "x")
    assert html_text.html_to_text("<a b=\"" * 200) is not None
    rng = random.Random(0)
    for _ in range(200):
        html_text.html_to_text("".join(rng.choice(["<p>", "</p>", "<li>", "<table>", "<td>", "</tr>", "<ul>", "</ul>", "x ", "&amp;", "<", ">", "\"", "<!--", "-->", "<pre>"]) for _ in range(40)))


def test_long_pages_take_time_in_proportion():
    import time

    def seconds(page):
        start = time.process_time()
        html_text.html_to_text(page)
        return time.process_time() - start

    n = 60_000
    for page in ("<p><button>" + "<div>a" * n, "<ul><li><table>" + "<tr><td>" * n, "<dl>" + "<dd><div>a</dd>" * n, "<p><object>" + "<b></p>" * n, "<select>" + "<option>a</b>" * n, "<svg>" + "<g><b>" * n, "<blockquote>a" * n, "<ul><li>a" * (n // 4), "<td></p>" * n, "<table><tr><td></i>" * 3_000):
        assert seconds(page) < 6, page[:30]
    assert seconds("<p><button>" + "<div>a" * 170_000) < 4  # a megabyte


@pytest.mark.parametrize(
    "html, text",
    [
        ('<ol data-start="7"><li>a</ol>', "1. a"), ("<ol start='+4'><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"), ("<ol><li value=x>a<li value=-2>b</ol>", "1. a\n-2. b"), ("<ul><li value=5>a</ul>", "- a"),
        ("<details><summary>s</summary><p>body</details>z", "s\nz"), ("<details open><summary>s</summary><p>body</details>z", "s\n\nbody\n\nz"), ("<details>body</details>z", "z"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d", "b\nd"), ("<div hidden>a<b style='visibility:visible'>b</b></div>d", "d"), ("<ul style=visibility:hidden><li>a<li style=visibility:visible>b</ul>", "- b"),
        ("<p style='backface-visibility:hidden'>a", "a"), ("<p style='display:none;display:block'>a", "a"), ("<p style='color:red; DISPLAY : NONE !important'>a</p>b", "b"), ("<p data-x='display:none'>a", "a"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>c", "| b\n\nc"),
        ("<table><tr><td>" + "x" * 70_000 + "<td>1" + "".join(f"<tr><td>{'a' * (i % 7)}<td>b" for i in range(40)) + "</table>", "x" * 70_000 + " | 1\n" + "\n".join(f"{'a' * (i % 7):6} | b" for i in range(40))),
    ],
)
def test_numbers_details_visibility_and_outsize_cells(html, text):
    assert html_text.html_to_text(html).strip() == text.strip()


# a second, recursive layout over trees that it draws itself


def _grow(rng, depth):
    """(tag, attributes, children) of a random block; strings are words."""
    word = lambda: " ".join(rng.choice(["ab", "c&amp;d", "é", "w"]) for _ in range(rng.randint(1, 3)))
    kind = rng.choice(["p", "div", "ul", "ol", "blockquote", "table", "h2", "text", "hide"]) if depth else "text"
    if kind == "text":
        return ("b", "", [word()])
    if kind in ("p", "h2"):
        return (kind, "", [x for _ in range(rng.randint(1, 3)) for x in (("i", "", [word()]), ("br", "", []))][:-1])
    if kind == "table":
        cols = rng.randint(1, 3)
        return ("table", "", [("tr", "", [("td", "", [word()]) for _ in range(cols)]) for _ in range(rng.randint(1, 3))])
    if kind in ("ul", "ol"):
        return (kind, "", [("li", "", [word(), *[_grow(rng, depth - 1) for _ in range(rng.randint(0, 2))]]) for _ in range(rng.randint(1, 3))])
    if kind == "hide":
        return ("div", rng.choice([" hidden", ' style="display:none"']), [word()])
    return (kind, "", [_grow(rng, depth - 1) for _ in range(rng.randint(1, 4))])


_OPTIONAL = {"p", "li", "td", "tr"}


def _write(node, rng, last=True):
    if isinstance(node, str):
        return node
    tag, attrs, children = node
    if tag == "br":
        return "<br>"
    inner = "".join(_write(c, rng) for c in children)
    # these end tags may be left out where the parent ends or the like of them begins
    return f"<{tag}{attrs}>{inner}" + ("" if tag in _OPTIONAL - {"p"} and rng.random() < 0.5 else f"</{tag}>")


def _lay(nodes, out, lead="", mark=None, inside=False):
    """Appends the lines of blocks to out; "" is a blank line. mark: what the first line has instead of the last level of lead."""
    from html import unescape

    marks, now = [mark] if mark else [], []

    def line(text):
        start = lead[: len(lead) - len(marks[0])] + marks.pop() if marks else lead
        out.append((start + text).rstrip())

    def end():
        if now:
            line("".join(now))
            now.clear()

    def blank():
        end()
        if out and out[-1] and not marks:
            out.append("")

    def inner(children, lead, inside=False):
        if marks:  # the first line below is the item's own
            raise AssertionError("items start with text here")
        _lay(children, out, lead, None, inside)

    for n in nodes:
        tag, attrs, children = ("#", "", [n]) if isinstance(n, str) else n
        if attrs:
            continue  # no box, no break
        if tag in ("#", "b", "i"):
            now.append(unescape("".join(children)))
        elif tag == "br":
            line("".join(now))
            now.clear()
        elif tag == "div":
            end(), inner(children, lead, inside)
        elif tag in ("p", "h2"):
            blank(), inner(children, lead), blank()
        elif tag == "blockquote":
            blank(), inner(children, lead + "  ", inside), blank()
        elif tag in ("ul", "ol"):
            end() if inside else blank()
            for k, item in enumerate(children):
                own = "- " if tag == "ul" else f"{k + 1}. "
                _lay(item[2], out, lead + " " * len(own), own, True)
            None if inside else blank()
        elif tag == "table":
            blank()
            cells = [[unescape(c[2][0]) for c in row[2]] for row in children]
            width = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
            for row in cells:
                line(" | ".join(c.ljust(w) if i < len(row) - 1 else c for i, (c, w) in enumerate(zip(row, width, strict=True))))
            blank()
    end()


def test_layout_equals_a_recursive_one():
    rng = random.Random(12)
    for _ in range(3_000):
        tree = [_grow(rng, 3) for _ in range(rng.randint(1, 4))]
        page = "".join(_write(n, rng) for n in tree)
        want = []
        _lay(tree, want)
        while want and not want[-1]:
            want.pop()
        assert html_text.html_to_text(page).split("\n") == (want or [""]), page


def test_quoted_values_of_any_length():
    import time

    for quote in "\"'":
        long = f"{quote}data:image/png;base64,{'iVBORw0KGgo+' * 30_000}a>b{quote}"
        assert html_text.html_to_text(f"<p>a <img src={long}>b</p>") == "a b"
        assert html_text.html_to_text(f"x<div data-x={long} hidden>gone</div>y") == "xy"
    assert html_text.html_to_text(f"<p don't>{'seen ' * 9_000}<p class='b'>z") == ("seen " * 9_000).strip() + "\n\nz"  # a quote opens values only
    for page in ("<a b=\"" * 40_001, "<a " * 40_000, "<a b='" * 40_001, "<a " * 40_000 + "b='", "<a b='\">" * 40_001, "<a b='<a c=\"" * 40_001):
        start = time.process_time()
        html_text.html_to_text(page)
        assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<select><option>x<option selected>y &amp; z<option>w</select>b", "a y & z b"), ("<select><option disabled>pick<option>x<option>y</select>", "x"), ("<select><optgroup label=g disabled><option>x</optgroup><option label=l>y</select>", "l"),
        ("<select multiple><optgroup label=g><option>x<option>y</select>", "g x y"), ("<select hidden><option>x</select>", ""), ("<select></select>z", "z"),
        ("<svg viewBox='0 0 1 1'><title>t</title><defs/><path d='M0 0'/><g><text x=1>one</text><text>t<tspan>wo</tspan></text></g><style>p{}</style></svg>after", "one two after"),
        ("<svg><defs><text>no</text></defs><symbol><text>no</text></symbol></svg>z", "z"), ("<svg/>z", "z"), ("<svg><path><p>kept</p>", "kept"), ("<svg><foreignObject><div>html</div></foreignObject></svg>z", "html\nz"),
        ("<object data=x.swf><param name=a><p>fall back</p></object>", "fall back"), ("<input type=submit value='Go &amp; find'> <input type=hidden value=h><input type=PASSWORD value=p><input value=shown><input type=button value=b hidden>", "Go & find shown"),
        ("<table><tr><td><select><option>x<option>y</select><td><input type=reset value=r></table>", "x | r"),
    ],
)
def test_forms_svg_and_objects(html, text):
    assert html_text.html_to_text(html) == text


def test_every_visible_word_of_the_pages_is_there(spark, sf):
    import re
    from html import unescape

    for r in registry.QUERIES["op10_html_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>|<style.*?</style>", " ", r["html"])
        want = unescape(re.sub(r"<[^>]+>", " ", body)).split()
        got = [w for w in r["text"].split() if w != "-"]
        assert got == [w for w in want if w != "-"]


# --- the pipeline


def test_pipeline_equals_plain_stages(spark, sf):
    import corpus_pipeline as c
    from tests.llm.test_dedup_operators import brute_components

    assert [len(s) for s in c.STAGES] == [2] * 5 and c.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = c.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    least = {}
    for i in sorted(kept):
        least.setdefault(" ".join(kept[i].split()) if kept[i].strip() == kept[i] else kept[i], i)
    kept = {i: kept[i] for i in least.values()}
    kept = {i: kept[i] for i, (_, _, stays) in brute_components(kept).items() if stays}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    got = {r["doc_id"]: r for r in c.run(spark, sf).collect()}
    assert {i: r["text"] for i, r in got.items()} == kept and all(len(r["pieces"]) == r["n_pieces"] for r in got.values())


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, sf):
    import corpus_pipeline as c

    for docs in (odd_docs, no_docs):
        for _, stage in c.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count()
