"""Intermediate tables in the shared folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go as it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a temporary folder serves in local mode only: a cluster would lose
    what is written to it, so there this raises."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="vaultflow-"))
    return path or sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a small table of few files would keep most of them idle. A table of many parts stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: they go with its query, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/vf-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def materialize_by(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """df as a table in as many buckets of key as a shuffle has parts, one file each: joins and sums by key leave its rows where they are.
    dealt: df's rows are by key already, so nothing is shuffled before they are written."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"vf_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    rows = df if dealt else df.repartition(n, key)
    with swept(spark):
        rows.sortWithinPartitions(key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


def discard(*written: DataFrame) -> None:
    """Delete what was written; nothing that is still to run may read it."""
    for df in written:
        if hasattr(df, "stored_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
