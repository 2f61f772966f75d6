"""Bounded samples of labelled documents, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a row that is learned from; a longer text is several rows of its label.
STRETCH = 65536


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> list[tuple[int, str, int]]:
    """At most ``per_class[y]`` (id, text, label) rows of each label y, 0 and 1, never from held-out ids.

    A text of more than ``stretch`` characters is cut into stretches, each a row of its own, so all of it can be learned from. The rows are
    the first by a hash of their id and place, so the driver holds ``per_class[y] * stretch`` characters of a label at most, and a
    long text fills the sample no more than in proportion.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(remainder("id", mod) != held_out).dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / stretch).cast("int") - 1, F.lit(0)))
    out = []
    for y in (0, 1):
        # sampled before the join: so many documents at most, whatever the size of the label table
        chosen = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * per_class[y])
        rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text", F.explode(places).alias("k"))
        rows = rows.select("id", F.col("text").substr(F.col("k") * stretch + 1, F.lit(stretch)).alias("text"), "y", "k")
        rows = rows.orderBy(F.xxhash64("id", F.when(F.col("k") > 0, F.col("k"))), "id", "k").limit(per_class[y])
        out += [(r["id"], r["text"], r["y"]) for r in rows.select("id", "text", "y").collect()]
    return out


def share_of(labels: DataFrame, label: str, mod: int, held_out: int, id_col: str = "doc_id") -> float | None:
    """Share of label 1 among the labelled rows that aren't held out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).filter(remainder(id_col, mod) != held_out)
    return known.agg(F.avg(F.col(label).cast("double"))).first()[0]


class Logistic:
    """Regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, share: float | None = None):
        """share: of label 1 where the model is used, if the rows have another one."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if share is not None and 0 < share < 1:
            drawn = y.mean()
            w[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
