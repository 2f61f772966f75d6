"""Tables cut out of the lineage and kept where every executor can read them."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_collected = 0.0
#: Seconds between two runs of the driver's collectors.
COLLECT_SECONDS = 2.0


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settle(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it.

    Survives the loss of executors (nothing is kept only in their memory or on their disks)
    and lets the next plan start from files with known sizes. The shuffle files of the plan that
    made it have no use any more; the driver's collectors run, if they didn't just now, so that Spark deletes them.
    """
    global _collected
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    _made[path] = spark
    if time.monotonic() - _collected > COLLECT_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    out = spark.read.schema(schema).parquet(path)
    out._settled = path
    return out


def sorted_join(side: DataFrame) -> DataFrame:
    """A side of a join that is merged by sorting, never broadcast: for tables that grow with the input and are joined in every round."""
    return side.hint("merge")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for files that aren't tables; ``forget()`` deletes it, too."""
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def forget(*frames: DataFrame) -> None:
    """Delete settled tables whose dependants are written; without arguments, all of them."""
    for path in [f._settled for f in frames] if frames else list(_made):
        spark = _made.pop(path, None)
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session is gone or the table is; the others still go
            continue


atexit.register(forget)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from here on in this session.

    Long texts make the usual 10,000 rows hundreds of megabytes, held twice by the JVM and by
    each Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000") or 10000) <= rows:
        spark.conf.set(key, str(rows))


#: Bytes of input between which ``spread`` deals rows out: less isn't worth a shuffle, more has parts enough.
SPREAD = (2 << 20, 1 << 30)


def spread(df: DataFrame, each: int | None = None) -> DataFrame:
    """A scan's rows dealt over all cores where a small table has fewer parts than those (one file of one row group).

    For work that costs far more than moving its input. With ``each``, parts hold about as many bytes of input at most, however large the table: for rows that
    become many, so that a task's memory doesn't grow with the row groups of a file. Which rows come out doesn't change.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    parts = max(parts, -(-size // each)) if each else parts
    least, most = (min(SPREAD[0], each), size) if each else SPREAD
    # a plan with shuffles has its parts already, and asking for their number would run it
    if not least <= size <= most or plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= parts:
        return df
    return df.repartition(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
