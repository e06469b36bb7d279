"""Cutting of lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Share of the largest heap from which on the driver's garbage is collected.
FULL = 0.4
#: Shuffle files of a write go when it ends, since its readers read the table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or a folder of our own where none is set and all runs in this process
    (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            found = f"file://{tempfile.mkdtemp(prefix='phenospark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage where its heap has grown: plans, shuffles and broadcasts of jobs that are over go. What a
    driver of many jobs keeps is small, but Java takes the heap up to its limit before it looks for what is not needed.
    What Java has freed outside of the heap (compiling of many plans leaves some hundred MB) goes back to the system, too."""
    jvm = spark.sparkContext._jvm
    heap = jvm.Runtime.getRuntime()
    if heap.totalMemory() > FULL * heap.maxMemory():
        gc.collect()  # Python's names of tables, too
        jvm.System.gc()
        trim(spark)


def trim(spark: SparkSession) -> bool:
    """Ask Java to give freed native memory back, as ``jcmd System.trim_native_heap`` does; False where it can't."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        of = jvm.java.lang.Class.forName
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:  # another Java, or not Linux
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, by columns, and read again: lineage ends here, and a lost executor takes nothing
    with it."""
    spark = df.sparkSession
    path = f"{shared(spark)}/phenospark-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its source has fewer splits than there are (one file of one row group, say); a table
    of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
