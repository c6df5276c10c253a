"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"


def by_value(module: str) -> None:
    """Send the functions of ``module`` to tasks whole, so that workers need not import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(cores: int | str = "*", app: str = "feedback_spark", **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config(SHARED_FOLDER, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine; elsewhere
    executors could not see it, so the missing setting is an error.
    """
    base = spark.conf.get(SHARED_FOLDER, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_FOLDER} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(SHARED_FOLDER, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies; nothing happens when it does not exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and scan it back.

    The result survives the loss of executors, is read with column pruning and
    gives the same rows in the same files however often it is scanned.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than there are cores over the cores; leave any wider input as it is.

    Test tables are single files of one row group. What this moves is at most one split per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
