"""What the operators of this subpackage share: table reading, shared scratch tables and small helpers."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from topicloom.storage import tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode,
    which has one machine, and an error on a cluster, whose machines share no such folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="topicloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(lambda: __import__("shutil").rmtree(root.removeprefix("file://"), ignore_errors=True))
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that ran there, never the stages before the table.
    The table goes when the application ends, or earlier through ``dropped``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _filesystem(spark, path)[0].deleteOnExit(_filesystem(spark, path)[1])
    read = spark.read.schema(df.schema).parquet(path)
    read._scratch_path = path
    tidied(spark)
    return read


def dropped(df: DataFrame) -> None:
    """Delete the table of ``stored`` once nothing will read it again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        fs, at = _filesystem(df.sparkSession, path)
        fs.delete(at, True)


def released(spark: SparkSession) -> None:
    """Let the context cleaner free the shuffle files of finished stages, which it does after a collection on the driver."""
    for _ in range(2):
        tidied(spark, 0)
        time.sleep(0.5)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
