"""Stage boundaries: a table written into the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Only a local-mode session (tests) may leave the setting unset; it then gets
    a temporary folder. On a cluster an unset setting is an error, because other
    executors would not see a machine-local folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-coop-"))
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def fewer_keys(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside leave their sides where they are if both are partitioned alike by some of the join's keys; the session's own setting comes back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, and Spark shuffles the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_count(df: DataFrame, at_least: int = 1) -> int:
    """Partitions for an explicit repartition: the session's setting."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
