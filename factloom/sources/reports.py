"""Usage statistics in files: the call log, session and global reports as JSON, CSV and text, and reading global statistics back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the call table, in this order.
CALL_CSV = ["call_id", "timestamp", "agent", "step", "provider", "model", "input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens", "latency_ms", "status", "retry_count", "estimated_cost_usd"]
GLOBAL = "documents long, total_tokens long, cost_usd double, avg_tokens double, avg_cost double, avg_duration double"


def write_call_log(calls: DataFrame, path: str, append: bool = True) -> None:
    """One JSON object a call and line."""
    calls.write.mode("append" if append else "overwrite").json(path)


def write_call_csv(calls: DataFrame, path: str) -> None:
    """The fixed columns with a header; those that are missing stay empty, total_tokens is the sum."""
    have = calls if "total_tokens" in calls.columns else calls.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    if "estimated_cost_usd" not in have.columns and "cost_usd" in have.columns:
        have = have.withColumn("estimated_cost_usd", F.col("cost_usd"))
    cols = [F.col(c).cast("string").alias(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in CALL_CSV]
    have.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def session_rows(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """(document_id, value): each session as a JSON object with its agents in it, by name."""
    of = [c for c in agents.columns if c != "document_id"]
    per = agents.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("agent", *[c for c in of if c != "agent"]))).alias("agents"))
    j = sessions.withColumnRenamed("agents", "agent_count").join(per, "document_id", "left")
    return j.select("document_id", F.to_json(F.struct(*[c for c in j.columns])).alias("value"))


def write_sessions(sessions: DataFrame, agents: DataFrame, path: str) -> None:
    session_rows(sessions, agents).select("value").write.mode("overwrite").text(path)


def _thousands(c: Column) -> Column:
    return F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)


def _money(c: Column, digits: int = 4) -> Column:
    return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", F.coalesce(c, F.lit(0.0)).cast("double")))


def session_text(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """(document_id, text): a summary to read, with a line for each agent."""
    line = F.concat(
        F.lit("  "), F.rpad("agent", 25, " "), F.lit(" | "), F.lpad(F.col("total_calls").cast("string"), 4, " "), F.lit(" calls | "), F.lpad(_thousands(F.col("total_tokens")), 8, " "),
        F.lit(" tokens | "), _money(F.col("cost_usd")), F.lit(" | avg "), F.format_string("%.0f", F.col("avg_latency_ms").cast("double")), F.lit("ms"),
    )
    per = agents.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("agent", line.alias("l")))).alias("_l"))
    j = sessions.join(per, "document_id", "left")
    named = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("=== Session "), "document_id", F.lit(" ===")), F.format_string("Duration : %.1fs", F.coalesce("duration_seconds", F.lit(0.0))), F.concat(F.lit("Calls    : "), F.col("total_calls").cast("string")),
        F.concat(F.lit("Tokens   : "), _thousands(F.col("total_tokens")), F.lit(" (in "), _thousands(F.col("total_input_tokens")), F.lit(", out "), _thousands(F.col("total_output_tokens")), F.lit(")")),
        F.concat(F.lit("Cost     : "), _money(F.col("cost_usd")), F.lit(", per 1000 characters "), _money(F.col("cost_per_1k_chars"), 6)), F.format_string("Budget   : %.1f%%", F.coalesce("budget_usage_pct", F.lit(0.0))),
        F.lit("--- agents ---"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n"), named("Over budget: ", F.col("steps_degraded")), named("Failed: ", F.col("steps_failed")),
    )
    return j.select("document_id", text.alias("text"))


def global_text(totals: DataFrame, types: DataFrame, models: DataFrame) -> DataFrame:
    """One row (text): the totals, then a line for each document type and each model. The three tables hold a few rows each."""
    t = types.agg(F.array_sort(F.collect_list(F.struct("document_type", F.concat(F.lit("  "), F.rpad("document_type", 10, " "), F.lit(" | "), F.lpad(F.col("documents").cast("string"), 4, " "), F.lit(" docs | avg "), F.format_string("%.0f", "avg_tokens"), F.lit(" tokens | avg "), _money(F.col("avg_cost_usd"))).alias("l")))).alias("t"))
    m = models.agg(F.array_sort(F.collect_list(F.struct("model", F.concat(F.lit("  "), F.rpad("model", 35, " "), F.lit(" | "), F.lpad(F.col("total_calls").cast("string"), 5, " "), F.lit(" calls | "), _money(F.col("total_cost_usd"))).alias("l")))).alias("m"))
    j = totals.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(m))  # one row each
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n--- {head} ---\n"), F.array_join(F.transform(c, lambda x: x["l"]), "\n")))
    text = F.concat_ws(
        "\n", F.lit("=== All documents ==="), F.concat(F.lit("Documents   : "), F.col("documents").cast("string")), F.concat(F.lit("Tokens      : "), _thousands(F.col("total_tokens"))), F.concat(F.lit("Cost        : "), _money(F.col("cost_usd"))),
        F.concat(F.lit("Tokens/doc  : "), _thousands(F.col("avg_tokens"))), F.concat(F.lit("Cost/doc    : "), _money(F.col("avg_cost"))), F.format_string("Seconds/doc : %.1f", F.coalesce("avg_duration", F.lit(0.0))),
        part("by document type", F.col("t")), part("by model", F.col("m")),
    )
    return j.select(text.alias("text"))


def write_global(totals: DataFrame, path: str) -> None:
    """The one row of totals as JSON."""
    totals.coalesce(1).write.mode("overwrite").json(path)  # one row


def load_global(spark: SparkSession, path: str) -> DataFrame | None:
    """Totals as written before; None where there are none or they can't be read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.schema(f"{GLOBAL}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    try:
        whole = rows.filter("_bad is null and documents is not null").drop("_bad").limit(1).collect()
    finally:
        rows.unpersist()
    return spark.createDataFrame(whole, GLOBAL) if whole else None
