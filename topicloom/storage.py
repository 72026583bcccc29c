"""Scratch tables: what several later steps read is computed once, and a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode,
    which has one machine, and an error on a cluster, whose machines share no such folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="topicloom-")
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared scratch folder and read back; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


_last_tidied = 0.0


def tidied(spark: SparkSession, every: float = 10.0) -> None:
    """Collect the driver's garbage, such as that of plans and task reports, every so many seconds at most, and give what
    is free then back to the system."""
    global _last_tidied
    if time.monotonic() - _last_tidied >= every:
        trimmed()
        _collected(spark)
        _last_tidied = time.monotonic()


def trimmed() -> None:
    """Give the free memory of this Python process back to the system, which the C library keeps otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def _collected(spark: SparkSession) -> None:
    """Collect the garbage of the driver's JVM, keep no more of its heap free than 40 %, in place of the usual 70 %, and give
    back what its compiler and threads have freed. A JVM that can't do the latter two just collects."""
    jvm = spark.sparkContext._jvm
    beans, option = jvm.java.lang.management.ManagementFactory, "MaxHeapFreeRatio"
    before = None
    try:
        hotspot = "com.sun.management.HotSpotDiagnosticMXBean"
        options = beans.getPlatformMXBean(jvm.java.lang.Class.forName(hotspot))
        usual = _called(spark, hotspot, options, "getVMOption", option).getValue()
        _called(spark, hotspot, options, "setVMOption", option, str(min(40, int(usual))))
        before = usual
    except Py4JError:
        pass
    jvm.System.gc()
    try:
        if before is not None:
            _called(spark, hotspot, options, "setVMOption", option, before)
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        _called(spark, "javax.management.MBeanServer", beans.getPlatformMBeanServer(), "invoke", commands, "systemTrimNativeHeap", None, None)
    except Py4JError:
        pass


def _called(spark: SparkSession, interface: str, on, method: str, *args):
    """Call a method through the interface that declares it, as the classes behind Java's management beans are not open."""
    context = spark.sparkContext
    found = next(m for m in context._jvm.java.lang.Class.forName(interface).getMethods() if m.getName() == method and m.getParameterCount() == len(args))
    values = context._gateway.new_array(context._jvm.java.lang.Object, len(args))
    for k, arg in enumerate(args):
        values[k] = arg
    return found.invoke(on, values)
