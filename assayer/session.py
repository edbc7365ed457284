"""Spark session defaults and the shared work folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_root = None


def get_spark(app: str = "assayer", cpus: str | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller supplies its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local master without that setting gets a fresh folder under /tmp; a cluster
    without it is an error, because a machine-local folder is lost with its machine.
    """
    global _local_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing existing is ever reused or removed."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str):
    """Write a result that several later steps read, and read it back: lineage ends in a table."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
