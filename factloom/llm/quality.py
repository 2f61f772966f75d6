"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe its characters and words, and those of the line
before and after it; transitions tie neighbouring labels. The field is trained on lines that carry
their document's label, by maximum conditional likelihood; as such lines never show a change of label, a normal
prior (``tie``) keeps the transitions small. Forward-backward gives each line's
marginal; their length-weighted mean, calibrated on training documents, is the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.llm.labelled import STRETCH, Logistic, remainder, sample, share_of
from factloom.llm.toxicity import scored_by

#: Labelled documents with label 0 and 1 that the field is fitted on.
PER_CLASS = (1500, 1500)
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "noise": [ord(c) for c in "#$%&*|<>{}[]=~^\\_@"], "shout": [ord("!")], "stop": [ord(c) for c in ".?"], "comma": [ord(c) for c in ",;:"], "high": range(128, 256)}
_LUT = {name: np.isin(np.arange(256), list(codes)) for name, codes in _CLASSES.items()}
N_FEATURES = 16


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, offsets of lines by text). A text without bytes has no line; blank lines weigh nothing."""
    n = len(raw)
    newline = raw == 10
    starts = np.zeros(n, bool)
    if n:
        starts[1:] = newline[:-1]
        starts[off[:-1][np.diff(off) > 0]] = True
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], n)
    lines = np.searchsorted(begin, off)
    size = np.maximum(end - begin, 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[begin]) / size

    words = T.Words(raw, np.append(begin, n))
    h = words.hashes()
    w = words.off
    count = np.diff(w).astype(float)
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = h[1:] == h[:-1]
        again[w[:-1][np.diff(w) > 0]] = False
    short = (words.end - words.start) <= 3
    marked = _LUT["noise"][raw[words.end - 1]] | _LUT["shout"][raw[words.end - 1]] if len(h) else np.zeros(0, bool)
    wide = _LUT["upper"][raw[words.start]] if len(h) else np.zeros(0, bool)

    def by_word(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(h) + 1)
        np.cumsum(mask, out=total[1:])
        return (total[w[1:]] - total[w[:-1]]) / np.maximum(count, 1)

    sums = np.zeros(len(h) + 1, T.U)
    with np.errstate(over="ignore"):
        np.cumsum(T.mix(h), out=sums[1:])
        bag = sums[w[1:]] - sums[w[:-1]]
    text_of = T.owners(lines).astype(T.U)
    _, inverse, seen = np.unique(T.mix(bag) ^ T.mix(text_of + T.U(1)), return_inverse=True, return_counts=True) if len(begin) else (None, np.zeros(0, int), np.zeros(0, int))
    x = np.column_stack([
        share(_LUT["upper"][raw]), share(_LUT["lower"][raw]), share(_LUT["digit"][raw]), share(_LUT["noise"][raw]), share(_LUT["shout"][raw]), share(_LUT["stop"][raw]),
        share(_LUT["comma"][raw]), share(_LUT["high"][raw]), by_word(again), by_word(short), by_word(marked), by_word(wide),
        np.log1p(size) / 5, np.log1p(count) / 5, np.minimum((words.end[np.maximum(w[1:] - 1, 0)] - words.start[np.minimum(w[:-1], max(len(h) - 1, 0))]) / np.maximum(count, 1), 40) / 10 if len(h) else np.zeros(len(begin)),
        np.minimum(seen[inverse] - 1, 5) / 5,
    ]) if len(begin) else np.zeros((0, N_FEATURES))
    weight = np.where(count > 0, size, 0.0)
    return x, weight, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features (zero at a text's ends) and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        first = lines[:-1][np.diff(lines) > 0]
        before[first] = 0
        after[first[1:] - 1] = 0
    return np.column_stack([x, before, after, np.ones(len(x))])


def forward_backward(potential: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of each line's two labels, expected transition counts summed over all texts).

    potential: log potentials (lines, 2). Texts run in step, longest first, so each step is one
    array operation over those that still have lines.
    """
    length = np.diff(lines)
    order = np.argsort(-length, kind="stable")
    start, length = lines[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # texts with more than t lines
    alpha, beta = potential.copy(), np.zeros_like(potential)
    e = np.exp(trans)

    def log_dot(a: np.ndarray, m: np.ndarray) -> np.ndarray:
        top = a.max(1, keepdims=True)
        return np.log(np.exp(a - top) @ m) + top

    for t in range(1, steps):
        at = start[: alive[t]] + t
        alpha[at] += log_dot(alpha[at - 1], e)
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = start[: alive[t]] + t
        to = potential[at] + beta[at]
        beta[at - 1] = log_dot(to, e.T)
        joint = alpha[at - 1][:, :, None] + trans + to[:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    both = alpha + beta
    both -= both.max(1, keepdims=True)
    both = np.exp(both)
    return both / both.sum(1, keepdims=True), pairs


def _summary(good: np.ndarray, weight: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """By text: length-weighted mean of the good marginals, their spread, log length; -1 where there is no line."""
    def total(v: np.ndarray) -> np.ndarray:
        s = np.zeros(len(v) + 1)
        np.cumsum(v, out=s[1:])
        return s[lines[1:]] - s[lines[:-1]]

    mass = total(weight)
    safe = np.maximum(mass, 1e-9)
    mean = total(weight * good) / safe
    bad = total(weight * (good < 0.5)) / safe
    return np.column_stack([mean, bad, np.log1p(mass), mass > 0])


class Model:
    """Field weights and calibration; without labelled documents of both classes, a constant."""

    def __init__(self, rows: list[tuple[int, str, int]], share: float | None = None, rounds: int = 120, ridge: float = 1e-4, tie: float = 1e-2):
        y = np.array([r[2] for r in rows], float)
        self.constant = share if share is not None else float(y.mean()) if len(y) else 0.5
        self.w = None
        if len(set(y.tolist())) < 2:
            return
        # by chunks, as in scoring: the hashes of a chunk are many times its text
        made = [line_features(raw, off) for _, _, raw, off in T.parts(pa.array([r[1] for r in rows], pa.large_string()))]
        x, weight = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        lines = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(m[2]) for m in made]))])
        del made
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = with_neighbours((x - self.mean) / self.scale, lines)
        label = y[T.owners(lines)].astype(int)
        gold = np.eye(2)[label]
        inner = np.ones(len(label), bool)
        inner[lines[:-1][np.diff(lines) > 0]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
        # each class counts the same; each line by its length
        emphasis = np.sqrt(np.minimum(weight, 2000))
        emphasis /= emphasis.mean() + 1e-9
        w, trans = np.zeros((z.shape[1], 2)), np.zeros((2, 2))
        m1 = [np.zeros_like(w), np.zeros_like(trans)]
        m2 = [np.zeros_like(w), np.zeros_like(trans)]
        for step in range(1, rounds + 1):
            marginal, pairs = forward_backward(z @ w, lines, trans)
            grads = [z.T @ ((marginal - gold) * emphasis[:, None]) / len(z) + ridge * w, (pairs - seen) / len(z) + tie * trans]
            for k, (param, g) in enumerate(zip((w, trans), grads, strict=True)):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                param -= 0.1 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        self.w, self.trans = w, trans
        good = forward_backward(z @ w, lines, self.trans)[0][:, 1]
        self.calibrate = Logistic(_summary(good, weight, lines), y, share=share)

    def _marginals(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, weight, lines = line_features(raw, off)
        z = with_neighbours((x - self.mean) / self.scale, lines)
        return forward_backward(z @ self.w, lines, self.trans)[0][:, 1], weight, lines

    def line_marginals(self, text: str) -> list[float]:
        """P(good) of each line of one text."""
        return self._marginals(*T.string_bytes(pa.array([text], pa.large_string())))[0].tolist()

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.w is None or not texts:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for i, j, raw, off in T.parts(pa.array(texts, pa.large_string())):
            summary = _summary(*self._marginals(raw, off))
            out[i:j] = np.where(summary[:, 3] > 0, self.calibrate(summary), self.constant)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> Model:
    return Model(sample(docs, labels, label, mod, held_out, per_class, id_col, text_col, stretch), share_of(labels, label, mod, held_out, id_col))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, held_out: int = 0, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Null, empty and blank texts have no weighed line and get the share of label 1 among the fitted
    rows. Without labelled rows of both classes every score is that share (0.5 without any). Repeated rows get
    equal results, rows without an id are left out, other columns don't matter.
    """
    out = scored_by(fit(docs, labels, "quality", mod, held_out, per_class, id_col, text_col, stretch), docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), (remainder("id", mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
