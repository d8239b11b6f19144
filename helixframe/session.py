"""Session-wide settings shared by the operators: scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
    return sc.getCheckpointDir()


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table.

    Written tables live until ``clear_scratch``, which a job calls when it needs
    no result of the operators any more.
    """
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application has written to the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Later stages restart from the written table, also after executor loss, and
    the planner sees its real size.  A written table is used rather than
    ``checkpoint()`` because that keeps the constraints of the old plan, which
    pile up over the rounds of an iterative job.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Tasks for stages whose work is far larger than their input, where merging small
    shuffle partitions by size would take the parallelism away."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def grid_side(spark: SparkSession) -> int:
    """Side of the task grid used for all-pairs work: side**2 is about one shuffle's width."""
    return max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
