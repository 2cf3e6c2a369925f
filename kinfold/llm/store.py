"""Tables in the shared folder, which cut lineage and outlive any executor."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from kinfold.sources.tables import remove, shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Later stages, and retries after a lost executor, start from these files. The shuffle files of df are
    garbage once it is written, and Spark deletes them then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinfold-{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables of materialize() that nothing still to run reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def trim() -> None:
    """Gives what this process has let go of (a model's training data) back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Gives back what the driver has let go of: plans and broadcasts of earlier steps, here and in executors (Spark's
    cleaner works on what collectors find), and what the C library holds free in the driver's two processes. In the
    JVM's that comes to hundreds of MB, as each of its threads that allocates may have a pool of its own."""
    trim()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    jvm.System.gc()
    # by reflection, as the server's class is hidden; a JVM or system without this command keeps its memory
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)


@functools.cache
def keep_memory(mb: int = 64) -> None:
    """From now on this process's C library, where it can, keeps up to so many MB that were let go of for the next
    arrays. By itself it returns them at once, and the system clears each page of the next array anew."""
    with contextlib.suppress(OSError, AttributeError):
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: its largest
        mallopt(-1, mb << 20)  # M_TRIM_THRESHOLD
        mallopt(-2, 16 << 20)  # M_TOP_PAD
