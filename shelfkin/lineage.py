"""Cutting lineage where a table is read more than once, and numbers of tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Of what is written: a third less disk than Spark's default for text and vectors.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The folder intermediate tables go to, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a local session, whose driver and executors share one disk,
    gets a folder of its own; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="shelfkin-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder once; later reads start from there and
    prune and filter at the scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shelfkin-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """A set number of tasks for stages with little data and much work per row, which the
    optimiser would otherwise merge by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
