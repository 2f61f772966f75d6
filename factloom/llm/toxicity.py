"""Toxicity by compression distance.

Two zstandard dictionaries of equal length are built from labelled text. Both begin with the
vocabulary of ordinary text, most frequent words last. Then the toxic one holds stretches of words
that are far more common in toxic training documents, the ordinary one filler that matches
nothing, so lengths differ only where a toxic stretch matches. A
window of text (about 48 bytes, cut between words) is compressed with each; the difference of the
lengths is its gain. A document's largest gains are calibrated to a probability on training
documents that the dictionaries in use for them have not seen (two folds).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.llm.labelled import STRETCH, Logistic, remainder, sample, share_of
from factloom.shared import small_batches, spread

WINDOW, GRAM = 48, 5
ORDINARY_BYTES, TOXIC_BYTES = 1 << 17, 1 << 15
#: Labelled documents with label 0 and 1 that dictionaries and thresholds are fitted on.
PER_CLASS = (6000, 1500)
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def flatten(text: str | None) -> bytes:
    """UTF-8, A-Z lower-cased, every other ASCII byte than a letter a space, runs of spaces one."""
    return b" " + b" ".join((text or "").encode().translate(_FLAT).split()) + b" "


def windows(flat: bytes, size: int = WINDOW) -> list[bytes]:
    """Stretches of at most ``size`` bytes from space to space (a longer word is cut); all bytes are in one."""
    out, i, n = [], 0, len(flat)
    while i < n - 1:
        j = min(i + size, n)
        if j < n and (k := flat.rfind(b" ", i + 1, j)) > i:
            j = k + 1
        out.append(flat[i:j])
        if j >= n:
            break
        i = j - 1 if flat[j - 1] == 32 else j
    return out


def _contexts(flats: list[bytes]) -> tuple[Counter, int]:
    """Of each word the number of different (word before, word, word after) it was seen in, and their total.

    Copies and shared passages repeat their contexts, so they count once.
    """
    ids: dict[bytes, int] = {}
    seen = [np.array([ids.setdefault(w, len(ids) + 1) for w in flat.split()], np.int64) for flat in flats]
    rows = [np.column_stack([np.append(0, s[:-1]), s, np.append(s[1:], 0)]) for s in seen if len(s)]
    if not rows:
        return Counter(), 0
    triples = np.concatenate(rows).astype(T.U)
    with np.errstate(over="ignore"):
        key = T.mix(triples[:, 0] * T._P + T.mix(triples[:, 1] + T.mix(triples[:, 2])))
    first = np.unique(key, return_index=True)[1]
    count = np.bincount(triples[first, 1].astype(np.int64), minlength=len(ids) + 1)
    return Counter({w: int(count[i]) for w, i in ids.items()}), len(first)


def _grams(words: Counter) -> Counter:
    """Contexts of each gram inside a word, with the word's spaces."""
    out: Counter = Counter()
    for w, n in words.items():
        w = b" " + w + b" "
        for g in {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}:
            out[g] += n
    return out


def contents(toxic: list[bytes], ordinary: list[bytes], word_odds: float = 3.5, gram_odds: float = 4.0, least_word: int = 6, least_gram: int = 4) -> tuple[bytes, bytes]:
    """Dictionary contents (ordinary, toxic) of equal length."""
    (w1, n1), (w0, n0) = _contexts(toxic), _contexts(ordinary)
    g1, g0 = _grams(w1), _grams(w0)

    def odds(a: int, b: int) -> float:
        return math.log((a + 0.1) / max(n1, 1)) - math.log((b + 0.1) / max(n0, 1))

    telling = {g for g, n in g1.items() if n >= least_gram and odds(n, g0[g]) > gram_odds}
    pieces: Counter = Counter()
    for w, n in w1.items():
        word = b" " + w + b" "
        i, hit = 0, False
        while i < len(word) - GRAM + 1:
            if word[i : i + GRAM] in telling:
                j = i
                while j < len(word) - GRAM + 1 and word[j : j + GRAM] in telling:
                    j += 1
                pieces[word[i : j + GRAM - 1]] += n
                i, hit = j, True
            else:
                i += 1
        if not hit and n >= least_word and odds(n, w0[w]) > word_odds:
            pieces[word] += n
    end = b"\0".join(p for p, n in sorted(pieces.items(), key=lambda x: (x[1], x[0])) if n > 1)[-TOXIC_BYTES:] + b"\0"
    common = (b" " + b" ".join(sorted(w0, key=lambda w: (w0[w], w))) + b" ")[-ORDINARY_BYTES:]
    return common + b"\0" * len(end), common + end


class Distance:
    """Gains of windows between two dictionaries; compressors are made once in each process."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._made = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_made": None}

    def _compressors(self):
        if self._made is None:
            import zstandard as z

            options = z.ZstdCompressionParameters(strategy=z.STRATEGY_BTLAZY2, min_match=GRAM, window_log=19, hash_log=17, chain_log=18, search_log=8, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = tuple(z.ZstdCompressor(compression_params=options, dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT)).compress for c in (self.ordinary, self.toxic))
        return self._made

    def features(self, text: str | None) -> tuple[float, ...]:
        """Largest gain, sum of the three largest, windows with a gain of 2 and of 4 bytes, their share, windows."""
        plain, toxic = self._compressors()
        gains = sorted((len(plain(w)) - len(toxic(w)) for w in windows(flatten(text))), reverse=True)
        if not gains:
            return (0.0,) * 6
        two, four = sum(g >= 2 for g in gains), sum(g >= 4 for g in gains)
        return max(gains[0], 0), max(sum(gains[:3]), 0), math.log1p(two), math.log1p(four), two / len(gains), math.log1p(len(gains))


class Model:
    """Dictionaries and calibration; without examples of both classes, a constant."""

    def __init__(self, rows: list[tuple[int, str, int]], share: float | None = None):
        flats = [flatten(t) for _, t, _ in rows]
        y = np.array([r[2] for r in rows], float)
        self.constant = share if share is not None else float(y.mean()) if len(y) else 0.5
        self.distance = None
        if len(set(y.tolist())) < 2:
            return
        fold = np.zeros(len(y), int)
        for c in (0, 1):
            own = np.flatnonzero(y == c)
            fold[own[1::2]] = 1
        x = np.zeros((len(y), 6))
        for f in (0, 1):
            seen = [i for i in range(len(y)) if fold[i] != f]
            d = Distance(*contents([flats[i] for i in seen if y[i]], [flats[i] for i in seen if not y[i]]))
            for i in np.flatnonzero(fold == f):
                x[i] = d.features(rows[i][1])
        self.calibrate = Logistic(x, y, share=share)
        self.distance = Distance(*contents([f for f, v in zip(flats, y, strict=True) if v], [f for f, v in zip(flats, y, strict=True) if not v]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.distance is None or not texts:
            return np.full(len(texts), self.constant)
        return self.calibrate(np.array([self.distance.features(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held_out: int = 2, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> Model:
    return Model(sample(docs, labels, label, mod, held_out, per_class, id_col, text_col, stretch), share_of(labels, label, mod, held_out, id_col))


def scored_by(model, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of each row by a model with ``score(texts)``, sent to each executor once."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries and weights: a fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.record_batch([pa.array(T.id_array(part.column(0))), pa.array(known.value.score(part.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    return spread(rows).mapInArrow(run, "id long, score double")


def keep_scored(model, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows with a score of at least ``threshold``, with all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries and weights: a fixed size
    at_text = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield part.filter(pa.array(known.value.score(part.column(at_text).to_pylist()) >= threshold))

    return spread(docs).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 4, held_out: int = 2, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted.

    Null and empty texts have no windows and get the score of a text without gains. Without labelled
    rows of both classes every score is the share of the label (0.5 without any). Repeated rows get
    equal results, rows without an id are left out, other columns don't matter.
    """
    out = scored_by(fit(docs, labels, "toxic", mod, held_out, per_class, id_col, text_col, stretch), docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), (remainder("id", mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
