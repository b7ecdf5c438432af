"""Session construction and lineage cutting.

The library never creates its own session inside an operator; jobs and
tests call :func:`get_session`.  On a cluster the session already exists and
its settings (shuffle partitions, checkpoint dir, memory) come from the
cluster configuration; the defaults here only fill in what is unset.
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins at runtime: a group-mean
# table that turns out small after the aggregate is broadcast, a large one
# stays a sort-merge join whose skewed partitions are split.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # a map built from several sources keeps the last value (config merge)
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def cluster_profile(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large cluster run, sized from the bytes a job reads.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (at least 2000) so that no reducer has to spill a giant partition;
    AQE then coalesces them to the advisory size and splits skewed ones.
    Scans read splits of the same size.  The broadcast threshold stays
    moderate: only tables measured small at run time are broadcast.
    """
    n = max(2000, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_profile(spark: SparkSession, conf: dict) -> None:
    """Set runtime SQL settings (e.g. from :func:`cluster_profile`)."""
    for k, v in conf.items():
        spark.conf.set(k, v)


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "postlens", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one for local runs and tests."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("POSTLENS_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.  Only in local mode
    (tests, benchmarks) is a private scratch folder created when it is unset;
    on a cluster an unset setting is an error rather than a machine-local
    folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors must be able to "
                           "read checkpoints written by others")
    local = tempfile.mkdtemp(prefix="postlens-ckpt-")
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder so that a lost
    executor does not force recomputation of a long lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Held while adaptive execution is off.
_PLAIN = threading.RLock()


def cut_lineage_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """:func:`cut_lineage` with the rows dealt by ``key`` over ``n`` partitions.
    Later groups by ``key`` know of it and shuffle nothing: adaptive execution,
    which hides how a plan's rows were dealt, is off for this one job."""
    conf = df.sparkSession.conf
    with _PLAIN:  # of two threads the second would take the first one's setting for the user's
        adaptive = conf.get("spark.sql.adaptive.enabled")
        conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return cut_lineage(df.repartition(n, key))
        finally:
            conf.set("spark.sql.adaptive.enabled", adaptive)


def beside(spark: SparkSession, run: Callable, *args) -> Future:
    """``run(*args)`` in a thread of its own: steps that loop over small jobs
    leave most cores idle, so others that do not need them run meanwhile."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(inheritable_thread_target(spark)(run), *args)
    finally:
        pool.shutdown(wait=False)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again, for
    tables that a loop makes anew of themselves.  A checkpoint keeps the
    estimate of its size that its plan had, and a join multiplies estimates: in
    a loop their digits double each step, until planning takes all the time.
    Files are as large as they are."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Deletes the files of :func:`stored` tables that nothing reads any more,
    and lets Spark delete what finished jobs shuffled: it does so once the
    driver's garbage is collected, which a loop of small jobs hardly brings
    about, so that the shuffles of all its steps would stay on disk."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    jvm.System.gc()


TEXT_PARTITIONS_KEY = "postlens.textPartitions"


def spread_text(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over ``postlens.textPartitions`` partitions before
    CPU-heavy per-row text work, when that setting is positive.

    Unset (the default), nothing changes: on real data the Parquet scan is
    already split by row groups and a shuffle of raw text would cost more
    than it saves.  Benchmarks on single-row-group files set it to the core
    count so that tokenization is not done by one task.
    """
    n = int(df.sparkSession.conf.get(TEXT_PARTITIONS_KEY, "0") or 0)
    return df.repartition(n) if n > 0 else df
