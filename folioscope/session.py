"""Session helpers: a local default session, shared-folder checkpoints, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated plan size, in bytes, that broadcast_if_small() will hint for broadcasting.
BROADCAST_BYTES = 32 << 20


def local_session(cores: str | int = "*", shuffle: int = 8, name: str = "folioscope") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    where = tempfile.mkdtemp(prefix="folioscope-")
    atexit.register(shutil.rmtree, where, True)
    path = os.path.join(where, "folioscope_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("folioscope", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where the driver is the executor (a local master) and none is set, a temporary one; a cluster without one is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            where = found.get()
        elif sc.master.split("[")[0] == "local":
            where = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the estimated size is under the limit; beyond it the join shuffles (AQE still may adapt)."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def scan_tasks(df: DataFrame) -> int:
    """Tasks of the largest scan under df, from the plan alone. (df.rdd would run every stage before the last, only to tell a number.)"""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    most = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        most = max(most, (leaf.executeColumnar() if leaf.supportsColumnar() else leaf.execute()).getNumPartitions())
    return most


def spread(df: DataFrame) -> DataFrame:
    """df over more tasks if its scans fill less than half of the cores, as with one small file; else unchanged. For steps that cost far more than moving their rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan_tasks(df) * 2 <= cores else df


def parallel(df: DataFrame, *keys: str) -> DataFrame:
    """df hashed by keys over all shuffle partitions, for steps whose work grows with the rows rather than with their bytes: a number that is asked for isn't coalesced by size. A distinct or a grouping by the keys that follows needs no shuffle of its own."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
