"""Incremental surfaces as Structured Streaming: new files, daily statistics, store upserts, token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.text import content_hash, exact_hash, format_of
from factloom.sources.stores import Table


def ingest_files(spark: SparkSession, root: str, cache_path: str, checkpoint: str) -> StreamingQuery:
    """New files of known formats that the cache hasn't seen (by exact, then content hash) are added to it, batch by batch; of equal ones the least path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    known = files.filter(format_of(F.col("path")).isNotNull())
    text = F.decode("content", "UTF-8")
    rows = known.select(F.col("path").alias("document_id"), exact_hash(F.col("content")).alias("exact_hash"), content_hash(text).alias("content_hash"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"))
    table = Table(spark, cache_path, ["document_id"])

    def put(batch: DataFrame, _: int) -> None:
        # equal bytes have equal contents, so the least path of a content stands for both
        rest = [c for c in batch.columns if c not in ("content_hash", "document_id")]
        least = batch.groupBy("content_hash").agg(F.min(F.struct("document_id", *rest)).alias("b"))
        new = least.select("content_hash", "b.*").select(*batch.columns)
        if table.exists():
            old = table.read()
            new = new.join(old.select("exact_hash"), "exact_hash", "left_anti").join(old.select("content_hash"), "content_hash", "left_anti")
        if new.limit(1).count():
            table.upsert(new)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consolidation_trigger(mode: str) -> dict | None:
    """Trigger of the corpus passes: with every ingestion what is new, on a schedule of an outside clock all that has gathered, by hand none."""
    return {"on_ingestion": {"processingTime": "0 seconds"}, "scheduled": {"availableNow": True}, "manual": None}[mode]


def consolidate_stream(changes: DataFrame, apply, checkpoint: str, mode: str = "scheduled") -> StreamingQuery | None:
    """Run ``apply(batch)`` over new rows of a stream as the mode says; manual starts nothing."""
    trigger = consolidation_trigger(mode)
    if trigger is None:
        return None
    return changes.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def daily_stats(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and tokens per day of a stream of calls, with a watermark so that state is bounded."""
    return calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")).select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "calls", "tokens")


def upsert_stream(rows: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Each batch replaces rows of equal keys in a store."""
    return rows.writeStream.foreachBatch(lambda batch, _: table.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consumed_tokens(calls: DataFrame) -> DataFrame:
    """Tokens used per document and agent so far; as a stream in update mode it is the running budget."""
    return calls.groupBy("document_id", "agent").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("consumed"))
