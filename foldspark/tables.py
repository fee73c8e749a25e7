"""Reading the input tables by name, and tables of intermediate results."""

from __future__ import annotations

import uuid
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: What was cached or written, in order, until it is released: DataFrames and folders.
_made: list[DataFrame | str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that all executors share.

    A cluster names that in spark.checkpoint.dir. Where it is unset, only a session
    on one machine may use a folder below the warehouse instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _made.append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written once to the shared folder and read again.

    Lost executors don't matter to what was written, and later passes don't
    compute it anew.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached(df: DataFrame) -> DataFrame:
    """df stored on the executors' disks as it is first computed, with its lineage.

    For what several later passes of one plan read: what a lost executor held is
    computed again from the inputs. Rounds that would make lineage long use kept().
    """
    out = df.persist(StorageLevel.DISK_ONLY)
    _made.append(out)
    return out


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM collect what finished plans hold, and with it Spark delete their shuffle files.

    Then it gives back to the system what it has freed: heap beyond what is in use,
    and native memory, of which planning and compiling leave it much. A JVM without
    the command for the latter (before 17.0.9, or not on Linux) only collects.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *items):
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    jvm.System.gc()
    # By reflection on the interface: the server's own class isn't open to calls.
    kinds = [jvm.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    with suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, command, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))


def made() -> int:
    """How much is cached or written by now: what release() takes as ``since``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Unpersist and delete what was cached or written since, but for the files that a DataFrame reads.

    Only for callers that know that no result of those steps is still to be
    computed; a query itself returns before its rows are.
    """
    used = but.inputFiles() if but is not None else []
    left = []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for x in _made[since:]:
        if isinstance(x, DataFrame):
            x.unpersist()
        elif any(f"/{x.rsplit('/', 1)[1]}/" in f for f in used):
            left.append(x)
        else:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
    _made[since:] = left
