"""Stale-marking of corpus facts: fresh, stale, deleted, as a stream with timers and as a batch recomputation.

A fact that one document alone supports goes stale when its staleness, 1 - 2 ** (-days / half-life) since its last confirmation, passes the threshold, and is deleted when it
has been stale for two half-lives. A confirmation makes it fresh again; one by another document makes it corroborated, and it never goes stale from then on. After
a deletion a fact begins anew. Transitions are rows (fact_id, status, at).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.functions import fixed

#: Staleness over which a fact is stale.
THRESHOLD = 0.2
DAY = 86_400_000_000


def spans(half_life: float = fixed.CORPUS_HALF_LIFE_DAYS, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Microseconds after the last confirmation at which a fact goes stale, and at which it goes."""
    stale = round(-half_life * math.log2(1 - threshold) * DAY)
    return stale, stale + round(2 * half_life * DAY)


def transitions(confirmations: DataFrame, until=None, half_life: float = fixed.CORPUS_HALF_LIFE_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """All transitions up to ``until`` (a timestamp column, default: as far as they go) of confirmations (fact_id, document_id, at).

    Confirmations without a fact or time are left out; a null document is one document. Windows only: a fact's first life that two documents share is never left, so what
    lies before is cut where gaps are long enough.
    """
    stale, gone = spans(half_life, threshold)
    rows = confirmations.filter("fact_id is not null and at is not null").select("fact_id", F.coalesce("document_id", F.lit("")).alias("document_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("t")).distinct()
    if until is not None:
        rows = rows.filter(F.col("t") <= F.unix_micros(until))
    w = Window.partitionBy("fact_id").orderBy("t", "document_id")
    rows = rows.withColumns({"before": F.lag("t").over(w), "after": F.lead("t").over(w)})
    rows = rows.withColumn("life", F.sum(F.when(F.col("t") - F.col("before") > gone, 1).otherwise(0)).over(w))
    own = F.first("document_id").over(Window.partitionBy("fact_id", "life").orderBy("t", "document_id"))
    rows = rows.withColumn("other", F.when(F.col("document_id") != own, F.col("t")))
    shared = F.min("other").over(Window.partitionBy("fact_id"))
    rows = rows.withColumn("shared", F.coalesce(shared, F.lit((1 << 63) - 1)))
    last = F.when(F.col("t") < F.col("shared"), F.coalesce("after", F.lit((1 << 63) - 1)))
    woke = F.col("before").isNull() | ((F.col("before") < F.col("shared")) & (F.col("t") - F.col("before") > stale))
    steps = F.array(
        F.when(woke, F.struct(F.lit("fresh").alias("status"), F.col("t").alias("us"))),
        F.when(last > F.col("t") + stale, F.struct(F.lit("stale").alias("status"), (F.col("t") + stale).alias("us"))),
        F.when(last > F.col("t") + gone, F.struct(F.lit("deleted").alias("status"), (F.col("t") + gone).alias("us"))),
    )
    out = rows.select("fact_id", F.explode(F.array_compact(steps)).alias("s"))
    out = out if until is None else out.filter(F.col("s.us") <= F.unix_micros(until))
    return out.select("fact_id", "s.status", F.timestamp_micros("s.us").alias("at"))


class _Marks(StatefulProcessor):
    """Confirmations wait until the watermark has passed them, so their order of arrival doesn't matter; one timer a fact, at the next thing due."""

    def __init__(self, stale: int, gone: int):
        self.stale, self.gone = stale, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, document_id string")
        self.fact = handle.getValueState("fact", "last long, document_id string, shared boolean, status string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            new = [(int(t), d) for t, d in zip(pdf["t"], pdf["document_id"], strict=True) if t > now]
            if new:
                self.waiting.appendList(new)
        return self._go_on(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return self._go_on(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _go_on(self, key, now: int) -> Iterator[pd.DataFrame]:
        held = self.fact.get() if self.fact.exists() else None
        last, document, shared, status, timer = held if held else (None, None, False, None, None)
        waiting = sorted({(t, d) for t, d in self.waiting.get()}) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        out: list[tuple[str, int]] = []

        def pass_time(until: int) -> None:
            """What happens by itself before ``until``."""
            nonlocal status
            if not shared and status == "fresh" and last + self.stale < until:
                status = "stale"
                out.append((status, last + self.stale))
            if status == "stale" and last + self.gone < until:
                status = None
                out.append(("deleted", last + self.gone))

        for t, d in due:
            if status:
                pass_time(t)
            if status != "fresh":
                out.append(("fresh", t))
            if status is None:
                document, shared = d, False
            shared = shared or d != document
            last, status = t, "fresh"
        if status:
            pass_time(now + 1)  # what comes later than the watermark can't change it
        ahead = [t for t, _ in later[:1]]
        if status and not shared:
            ahead.append(last + (self.stale if status == "fresh" else self.gone))
        at = -(-min(ahead) // 1000) if ahead else None
        if timer is not None and timer != at and timer * 1000 > now:
            self.handle.deleteTimer(timer)
        if at is not None and (timer != at or timer * 1000 <= now):
            self.handle.registerTimer(at)
        if later != waiting:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if status or later:
            self.fact.update((last, document, shared, status, at))
        else:
            self.fact.clear()
        if out:
            yield pd.DataFrame({"fact_id": [key[0]] * len(out), "status": [s for s, _ in out], "us": [t for _, t in out]})

    def close(self) -> None:
        pass


def stream(confirmations: DataFrame, late: str = "1 day", half_life: float = fixed.CORPUS_HALF_LIFE_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """Transitions of a stream of confirmations (fact_id string, document_id, at), each once the watermark (``late`` behind the latest) has passed it.

    Up to the watermark they equal ``transitions``; what comes later than that is left out. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = confirmations.filter("fact_id is not null and at is not null").withWatermark("at", late)
    rows = rows.select("fact_id", F.coalesce("document_id", F.lit("")).alias("document_id"), F.unix_micros("at").alias("t"), "at")
    marked = rows.groupBy("fact_id").transformWithStateInPandas(_Marks(*spans(half_life, threshold)), "fact_id string, status string, us long", "Append", "EventTime")
    return marked.select("fact_id", "status", F.timestamp_micros("us").alias("at"))
