"""Session helpers: a local session for tests and benches, and a shared scratch area.

Library code never creates its own session; it takes the caller's.  Scratch data
(checkpoints, written intermediate tables) always goes under the folder the cluster
names in ``spark.checkpoint.dir``.  Only when that setting is absent (a local test
session) do we pick a private temporary folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
# scratch paths handed out in this process, for ``drop_scratch``
_SCRATCH: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textpairs") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only when the session has none."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{_CKPT_KEY} must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="textpairs-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for a written table."""
    root = checkpoint_root(spark)
    path = root.rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """A mark for ``drop_scratch``: scratch paths handed out after it belong to the caller."""
    return len(_SCRATCH)


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch tables handed out since ``since`` (a ``scratch_mark``); call when no
    DataFrame reads them any more, e.g. at the end of a job step.  Returns how many."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while len(_SCRATCH) > since:
        p = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            removed += 1
    return removed


_LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_PER_CORE = 4


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """While held, readers list many paths in a few tasks a core, instead of one task for each path (up to 10,000): a task costs
    much more than the listing of a path.  A value that the session has stays.  Readers list when they are made, a stream when it runs."""
    if spark.conf.get(_LISTING_KEY, "10000") != "10000":
        yield
        return
    spark.conf.set(_LISTING_KEY, str(LISTING_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING_KEY)


SPREAD_MAX_BYTES = 1 << 30
SPREAD_PER_CORE = 3


def estimated_bytes(df):
    """The optimizer's size estimate of ``df``, or None when it is unknown (no statistics,
    which Spark reports as a huge default) or not reachable from this client."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None
    return None if size >= (1 << 62) else size


def spread(df, *keys, max_bytes: int = SPREAD_MAX_BYTES):
    """Hash-spread a *small* scan that yields fewer partitions than the session's parallelism.

    A small file with one row group would otherwise run all downstream row work in one
    task.  Inputs above ``max_bytes`` (optimizer size estimate) are never re-shuffled:
    at scale the scan's own splits are the parallelism, and a full shuffle of the raw
    table would cost more than it saves.
    """
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
        # a few partitions per core, so rows of very different sizes even out across cores
        want = SPREAD_PER_CORE * cores
    except Exception:  # sessions without a local JVM view (e.g. remote clients): leave the plan alone
        return df
    size = estimated_bytes(df)
    if size is None or size > max_bytes:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage of a table that several later jobs reuse; survives executor
    loss (unlike a local checkpoint) because the files live in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_alone(spark: SparkSession, make, name: str):
    """``materialize(make(), name)``; the scratch tables that ``make`` has written are deleted once it is there."""
    path = scratch_path(spark, name)
    mark = scratch_mark()
    make().write.mode("overwrite").parquet(path)
    drop_scratch(spark, mark)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
