"""The folder that the driver and all executors share."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from glyphworks.llm._pieces import give_back

#: Used only where the session names no folder and driver and executors are one process, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/glyphworks"
#: Seconds between two trims of the driver, which take about a tenth of one.
TRIM_S = 4.0
_trimmed = {"at": -TRIM_S}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; on a cluster there has to be one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim_driver(spark: SparkSession) -> None:
    """Returns what the driver's JVM and Python have freed outside the heap to the system.

    Compilers and codecs of many jobs leave hundreds of megabytes in the C library's arenas otherwise.
    """
    if time.monotonic() - _trimmed["at"] < TRIM_S:
        return
    give_back()
    sc = spark.sparkContext
    java = sc._jvm.java.lang
    arguments = sc._gateway.new_array(java.Object, 4)
    try:
        # by reflection: the server's own class is not open to others
        (invoke,) = (m for m in java.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        arguments[0], arguments[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:  # a JVM or C library without it
        pass
    _trimmed["at"] = time.monotonic()


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: later jobs read it, whatever executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
