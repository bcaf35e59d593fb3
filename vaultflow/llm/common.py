"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import swept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters, digits and anything beyond ASCII, after ASCII lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between such runs.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a temporary one serves in local mode,
    as all tasks run in the driver there; a cluster would lose what is written to it, so there this raises."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if path:
        if not known.isDefined():
            sc.setCheckpointDir(path)
        return path
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vaultflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there,
    lost executors cost nothing, and the planner knows the size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vf-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def materialize_by(df: DataFrame, key: str) -> DataFrame:
    """Like materialize, as a table in as many buckets of key as a shuffle has parts: joins on key leave its rows where they are."""
    spark = df.sparkSession
    name = f"vf_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    with swept(spark):
        df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


def discard(*written: DataFrame) -> None:
    """Delete what materialize wrote; nothing that is still to run may read it."""
    for df in written:
        if hasattr(df, "stored_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. Text of ASCII alone takes Spark's faster lower()."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def quoted(values) -> str:
    """SQL string literals, comma-separated; NULL for none."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) or "NULL"


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of fewer parts than there are cores is dealt to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def temp_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = f"_vf_{name}"
    while out.lower() in taken:
        out += "_"
    return out
