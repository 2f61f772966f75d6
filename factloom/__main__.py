"""Command line: ``python -m factloom analyze FILE``, ``batch FOLDER``, ``stats FOLDER``.

analyze and batch extract texts, cut them into chunks and write both; batch leaves out files whose
content is known already. Model passes belong to a job of one's own (see ``plans.stages``).
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_hash, exact_hash, format_of
from factloom.operators import chunking, dedup, tracking
from factloom.plans import logs
from factloom.plans.settings import Settings, SettingsError
from factloom.shared import settle
from factloom.sources import readers
from factloom.sources.stores import Files, Table


def _process(files: DataFrame, out: str, settings: Settings) -> DataFrame:
    """Writes documents and chunks under ``out``; returns the extracted documents with their errors."""
    got = settle(readers.extract(files, longest=settings.max_document_size_mb << 20), "extracted")
    good = readers.oversize(got.filter("error is null"), "raw_text", settings.max_document_tokens, settings.oversize_strategy)
    docs = good.select(F.col("path").alias("document_id"), "format", "raw_text")
    docs.write.mode("append").parquet(f"{out}/documents")
    chunks = chunking.structural(docs, "document_id", "raw_text", settings.chunk_target_size, settings.chunk_overlap)
    chunks.write.mode("append").parquet(f"{out}/chunks")
    return got


def analyze(spark: SparkSession, path: str, out: str, settings: Settings) -> dict:
    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", format_of(F.col("path")).alias("format"), "content")
    if rows.filter("format is not null").isEmpty():
        raise SystemExit(f"no file of a known format: {path}")
    errors = _process(rows.filter("format is not null"), out, settings).filter("error is not null").select("path", "error").collect()  # one file
    return {"document": path, "errors": [r["error"] for r in errors]}


def batch(spark: SparkSession, folder: str, out: str, settings: Settings, formats: list[str] | None = None, recursive: bool = True) -> dict:
    """Counts of files found, processed, skipped and failed; what was processed is known from then on."""
    found = readers.scan(spark, folder, recursive, formats or list(settings.batch_formats))
    hashed = settle(found.select(F.col("path").alias("document_id"), exact_hash(F.col("content")).alias("exact_hash"), content_hash(F.decode("content", "UTF-8")).alias("content_hash")), "hashes")
    cache = Table(spark, f"{settings.cache_path}/entries", ["document_id"])
    known = cache.read() if settings.cache_enabled and cache.exists() else hashed.limit(0)
    entries = settle(dedup.cascade(hashed, known, "document_id"), "entries")
    new = entries.filter("cache_status = 'new'").select(F.col("document_id").alias("path"))
    done = _process(found.join(new, "path", "left_semi"), out, settings)
    failed = settle(done.filter("error is not null").select(F.col("path").alias("document_id"), "error"), "failed")
    if settings.cache_enabled:
        cache.upsert(hashed.join(new.withColumnRenamed("path", "document_id"), "document_id", "left_semi").join(failed.select("document_id"), "document_id", "left_anti"))
    return tracking.batch_counts(entries, failed).first().asDict()


def stats(spark: SparkSession, root: str) -> list[dict]:
    """Runs of each document folder."""
    files = Files(spark, root)
    return [{"document_id": d, "runs": len([r for r in files.list(f"{d}/runs") if not r.endswith(".json")])} for d in files.list() if files.exists(f"{d}/runs")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="one document")
    a.add_argument("file")
    b = sub.add_parser("batch", help="all new documents of a folder")
    b.add_argument("folder")
    b.add_argument("--formats", help="by commas")
    b.add_argument("--no-recursive", action="store_true")
    for x in (a, b):
        x.add_argument("--output", default=None)
        x.add_argument("--chunk-size", type=int, default=None)
    s = sub.add_parser("stats", help="documents and runs of a folder")
    s.add_argument("folder")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = Settings.from_env().with_overrides({"output_path": getattr(args, "output", None), "chunk_target_size": getattr(args, "chunk_size", None)})
    except SettingsError as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    log = logs.setup(settings.log_level, settings.log_format, settings.log_file, settings.log_rotation, settings.log_retention)
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    with logs.context(step=args.command):
        if args.command == "analyze":
            found = analyze(spark, args.file, settings.output_path, settings)
        elif args.command == "batch":
            found = batch(spark, args.folder, settings.output_path, settings, args.formats.split(",") if args.formats else None, not args.no_recursive)
        else:
            found = stats(spark, args.folder)
        log.info("%s done", args.command)
    print(json.dumps(found))
    return 1 if args.command == "analyze" and found["errors"] else 0


if __name__ == "__main__":
    sys.exit(main())
