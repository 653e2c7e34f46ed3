"""Session helpers: a local session for tests/bench, and lineage cutting that respects the cluster."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "causeway") -> SparkSession:
    """Session for tests and the local bench. On a cluster, the caller's session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names; only set one (under /tmp) when none is set.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is left untouched.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="causeway-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a frame reused by several jobs (cross-fit residuals, refit loops).

    A reliable checkpoint in the shared checkpoint folder survives executor loss, unlike
    a cache or a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cached(df: DataFrame) -> DataFrame:
    """Cache a small, cheaply recomputed frame that several aggregates read (lost blocks recompute)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def held_rows(df: DataFrame) -> Iterator[DataFrame]:
    """The frame stored and dealt out over the cores, for the passes of one estimate: what it reads and joins is read and
    joined once, not in each pass. Lost blocks recompute; it goes when the estimate is done."""
    rows = cached(spread(df))
    try:
        yield rows
    finally:
        rows.unpersist()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Files of a query's shuffles go when it has ended, not when the driver next collects garbage: for rounds of
    queries that each read the table anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Before row-multiplying work (bootstrap replicates, simulations) or iterative fits, make sure a
    small input is spread over the cluster's cores.

    Decided from the plan, so nothing is executed (asking for the RDD's partition count would run the
    upstream shuffle stages under AQE): scan splits follow the scanned files, so the largest leaf
    relation's size is compared with ``spark.sql.files.maxPartitionBytes`` x cores. (The optimizer's
    estimate for a join without table statistics is far too high to use.) A small input gets a
    round-robin repartition; a large table (the 100 TB case) is left as it is.
    """
    try:
        spark = df.sparkSession
        target = min_partitions or spark.sparkContext.defaultParallelism
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = max(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        split = int(str(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728")).rstrip("b").rstrip("B") or 134217728)
    except Exception:  # noqa: BLE001  sessions without JVM access: leave the plan as it is
        return df
    return df.repartition(target) if size < split * target else df
