"""Session settings and small helpers every operator shares."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOCAL_TASKS = "spark.wardline.localTasks"

# A side is broadcast only when the optimizer's size estimate is under this bound.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "wardline") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    tasks = os.cpu_count() if cores == "*" else cores
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.enabled", "false")
        .config(LOCAL_TASKS, str(tasks))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a local session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a step to a table in the cluster's shared folder and read it back.

    The plan starts anew from files that survive the loss of executors, and their real size replaces an
    estimate that would multiply along joins. The step is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the driver and the executors share, if it is there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-steps-", dir="/tmp")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, where stateful stream operators need its classes."""
    context = spark.sparkContext
    if any(os.path.basename(f).startswith("wardline-") for f in context._python_includes or ()):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-package-", dir="/tmp"), f"wardline-{uuid.uuid4().hex}")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate of the plan; nothing is executed."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    try:
        return int(str(stats.sizeInBytes()))
    except ValueError:  # estimates multiply along joins and may have thousands of digits
        return 1 << 62


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that take long each over all tasks, by the hash of ``keys``.

    A small table is read by few tasks, and AQE would put its small partitions together again; it leaves a given number alone.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the size estimate proves it fits, else leave the choice to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that is computed exactly once per row.

    A later filter on a plain projection is pushed below it and evaluates the expression a second
    time; nothing is pushed through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
