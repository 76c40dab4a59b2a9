"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Where it is unset, a local master (tests) gets a temporary folder; a cluster without it is refused,
    since a machine-local folder would lose lineage cuts with the machine.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeep-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def free(*dfs: DataFrame) -> None:
    """Delete tables of `materialise` and `hold` that no plan still to be run reads."""
    for df in dfs:
        if getattr(df, "_held", False):
            df.unpersist()
        for at, (spark, path) in enumerate(_written):
            if path == getattr(df, "_scratch", None):
                _delete(spark, path)
                del _written[at]
                break


@atexit.register
def release() -> None:
    """Delete every table that `materialise` wrote in this process."""
    while _written:
        _delete(*_written.pop())


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # by which `free` knows it
    return out


def materialise_few(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """As `materialise`, but a file for each `advisoryPartitionSizeInBytes` of shuffled rows, not one for each core at least.

    For tables that are small for the work they take: without its native library Hadoop starts three children of an executor
    for each file it writes to a local folder.  Where the last shuffle is larger than its result, or the work after it heavy, `by`
    names a column by which the rows are gathered once more before they are written.
    """
    conf = df.sparkSession.conf
    before = conf.get(_PARALLEL)
    if by:
        df = df.hint("rebalance", F.col(by))
    conf.set(_PARALLEL, "false")
    try:
        return materialise(df, label)
    finally:
        conf.set(_PARALLEL, before)


def hold(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it on the executors' disks, by Spark's own cache: no files are written to the shared folder.

    For tables made without a shuffle, whose files Spark would have to keep as long.  What a lost executor held is computed
    again from the plan of `df`, which stays part of the plans built on it.
    """
    # the cache knows tables by their plans: a name of its own keeps this one from serving a later read of changed files
    out = df.where(F.lit(uuid.uuid4().hex).isNotNull()).persist(StorageLevel.DISK_ONLY)
    out.count()
    out._held = True
    return out
