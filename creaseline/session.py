"""Session helper and the one place that decides where checkpoints live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Files of repetitive rows are many times smaller than the rows in memory, on disk and on the wire: the first setting
#: keeps Spark from broadcasting large tables for their small files, the second keeps what one task sorts or hashes small.
SIZES = {"spark.sql.sources.fileCompressionFactor": "10.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def set_sizes(spark: SparkSession) -> None:
    """`SIZES` in a session of any origin, but for those that it sets itself."""
    for key, value in SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    On a cluster pass nothing: master and partition counts come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName("creaseline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    set_sizes(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a temporary one only in a single-machine session without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="creaseline-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a reused intermediate table so that lost executors do not replay its history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and return the written table.

    The files go below the shared checkpoint folder, so column pruning, file statistics and recovery
    after a lost executor all work from storage instead of from a replayed plan.
    """
    root = ensure_checkpoint_dir(df.sparkSession)
    path = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
