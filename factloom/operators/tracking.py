"""Usage statistics over a table of model calls.

Calls: document_id, agent, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
latency_ms, retry_count, status, timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_CALL = 4096


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd by prices per million tokens (model, input_price, output_price, cache_read_price, cache_write_price); unknown models cost 0.

    The price table is joined plainly; Spark broadcasts it where its size allows.
    """
    j = calls.join(prices, "model", "left")
    cost = sum((F.col(f"{k}_tokens") * F.col(f"{k}_price") for k in ("input", "output", "cache_read", "cache_write")), F.lit(0.0)) / 1e6
    return j.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("input_price", "output_price", "cache_read_price", "cache_write_price")


def by_agent(calls: DataFrame, budget: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per agent: calls, tokens, latency, retries, failures, cost, share of a budget."""
    total = F.col("input_tokens") + F.col("output_tokens")
    g = calls.groupBy(*by, "agent").agg(
        F.count("*").alias("total_calls"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.sum(total).alias("total_tokens"),
        F.sum("cache_read_tokens").alias("total_cache_read_tokens"), F.sum("cache_write_tokens").alias("total_cache_write_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.sum("retry_count").alias("retry_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"), F.sum("cost_usd").alias("cost_usd"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )
    return g.withColumn("budget_pct", F.col("total_tokens") / budget * 100 if budget else F.lit(0.0))


def sessions(calls: DataFrame, budget: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Per document: totals over its agents, duration, cost per 1000 characters, agents over budget or with failures.

    Two levels: agents first, then documents; the second reuses the first's partial sums.
    """
    a = by_agent(calls, budget, ("document_id",))
    if sizes is not None:
        a = a.join(sizes, "document_id", "left")
    else:
        a = a.withColumn("size_chars", F.lit(0))
    over = F.col("total_tokens") > budget if budget else F.lit(False)
    g = a.groupBy("document_id").agg(
        F.sum("total_calls").alias("total_calls"), F.sum("total_input_tokens").alias("total_input_tokens"), F.sum("total_output_tokens").alias("total_output_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("agents"), F.min("first_at").alias("start_time"), F.max("last_at").alias("end_time"), F.max("size_chars").alias("size_chars"),
        F.array_sort(F.collect_list(F.when(over, F.col("agent")))).alias("steps_degraded"), F.array_sort(F.collect_list(F.when(F.col("failure_count") > 0, F.col("agent")))).alias("steps_failed"),
    )
    allocated = F.col("agents") * (budget or 0)
    return g.withColumns({
        "duration_seconds": (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6,
        "cost_per_1k_chars": F.when(F.col("size_chars") > 0, F.col("cost_usd") / (F.col("size_chars") / 1000)).otherwise(0.0),
        "budget_usage_pct": F.when(allocated > 0, F.col("total_tokens") / allocated * 100).otherwise(0.0),
    })


def totals(s: DataFrame) -> DataFrame:
    """One row over all sessions."""
    return s.agg(F.count("*").alias("documents"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"), F.avg("total_tokens").alias("avg_tokens"), F.avg("cost_usd").alias("avg_cost"), F.avg("duration_seconds").alias("avg_duration"))


def by_type(s: DataFrame, types: DataFrame) -> DataFrame:
    """Per document type (document_id, document_type, chunks): count and means."""
    j = s.join(types, "document_id", "left").withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))
    return j.groupBy("document_type").agg(F.count("*").alias("documents"), F.avg("total_tokens").alias("avg_tokens"), F.avg("cost_usd").alias("avg_cost_usd"), F.avg("duration_seconds").alias("avg_duration_seconds"), F.avg("chunks").alias("avg_chunks"))


def agents_overall(calls: DataFrame) -> DataFrame:
    """Per agent over all documents, with its share of all tokens (which stands for its share of cost)."""
    a = by_agent(calls)
    total = a.agg(F.sum("total_tokens").alias("_all"))
    j = a.crossJoin(F.broadcast(total))  # one row
    return j.select("agent", "total_calls", "total_tokens", (F.col("total_tokens") / F.col("total_calls")).alias("avg_tokens_per_call"), (F.col("failure_count") / F.col("total_calls")).alias("failure_rate"), "avg_latency_ms", (F.col("total_tokens") / F.col("_all") * 100).alias("pct_of_total_tokens"))


def by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("total_calls"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.sum("cost_usd").alias("total_cost_usd"))


def by_day(s: DataFrame) -> DataFrame:
    """Per day of a session's end: documents, tokens, cost."""
    return s.groupBy(F.date_format("end_time", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("documents_processed"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("total_cost_usd"))


def counters(rows: DataFrame, **conditions: str) -> DataFrame:
    """One row: total and, by name, how many rows each condition (SQL text) holds for."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()])


def contradiction_counts(found: DataFrame) -> DataFrame:
    return counters(found, opposing="kind = 'opposing_predicate'", values="kind = 'value_conflict'", high="severity = 'high'")


def decay_counts(aged: DataFrame, prune_below: float) -> DataFrame:
    return counters(aged, decayed="decay_factor < 1", undated="decay_factor is null", pruned=f"decay_factor is not null and confidence < {float(prune_below)}")


def inference_counts(inferred: DataFrame) -> DataFrame:
    """(rule, inferred): how many facts each rule gave."""
    return inferred.groupBy("rule").agg(F.count("*").alias("inferred"))


def linking_counts(linked: DataFrame) -> DataFrame:
    return counters(linked, by_name="how = 'name'", by_alias="how in ('alias', 'incoming alias')", by_embedding="how = 'embedding'", new="target is null")


def batch_counts(entries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: files_found, processed, skipped, errors of scanned entries (document_id, cache_status); known ones are skipped, failed (document_id) are errors."""
    new = F.col("cache_status") == "new"
    bad = F.lit(False)
    if failed is not None:
        entries = entries.join(failed.select("document_id").distinct().withColumn("_bad", F.lit(True)), "document_id", "left")
        bad = F.coalesce("_bad", F.lit(False))
    return entries.agg(F.count("*").alias("files_found"), F.count_if(new & ~bad).alias("processed"), F.count_if(~new).alias("skipped"), F.count_if(new & bad).alias("errors"))


def merge_mean(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Means kept as (key, total, n): adding two such tables is one union and one sum."""
    g = old.select(key, "total", "n").union(new.select(key, "total", "n")).groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return g.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))


def estimate_budget(docs: DataFrame, per_call: int = PER_CALL, density: int = 5, critic: bool = False) -> DataFrame:
    """(document_id, agent, allocated) from document_id, text_tokens, n_chunks, n_images."""
    n, t = F.col("n_chunks"), F.col("text_tokens")
    at_least_one = lambda d: F.greatest(F.lit(1), F.floor(n / d))
    parts = {
        "image_analyzer": F.col("n_images") * 1000, "reference_extractor": F.least(t, F.lit(per_call)), "decontextualizer": n * per_call, "summarizer": n * per_call, "densifier": F.lit(density * per_call),
        "concept_extractor": n * per_call, "entity_normalizer": at_least_one(5) * per_call, "relation_normalizer": at_least_one(10) * per_call, "community_summarizer": at_least_one(3) * per_call,
        "profile_generator": at_least_one(3) * 2 * per_call, "synthesizer": F.lit(2 * per_call), "critic": F.lit(2 * per_call if critic else 0),
    }
    rows = F.array(*[F.struct(F.lit(a).alias("agent"), v.cast("long").alias("allocated")) for a, v in parts.items()])
    return docs.select("document_id", F.explode(rows).alias("x")).select("document_id", "x.agent", "x.allocated")


def over_budget(allocated: DataFrame, calls: DataFrame) -> DataFrame:
    """(document_id, agent, allocated, consumed, within)."""
    used = calls.groupBy("document_id", "agent").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("consumed"))
    j = allocated.join(used, ["document_id", "agent"], "full")
    return j.select("document_id", "agent", F.coalesce("allocated", F.lit(0)).alias("allocated"), F.coalesce("consumed", F.lit(0)).alias("consumed")).withColumn("within", F.col("consumed") <= F.col("allocated"))
