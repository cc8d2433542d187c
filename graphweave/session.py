"""Small helpers around the session: reading tables, spreading work, cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``.

    Spark 4.1 can plan a union as partitioned like its parts; after adaptive coalescing these may differ in number, and the
    job fails. That option is switched off for the session.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy in Python.

    A table of many files already has that many and is left alone; only a small table of few files is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of few short columns that are broadcast at most.
MOST_BROADCAST = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``MOST_BROADCAST`` rows, which is counted; else as it is, for a shuffle join.
    Give it a table that is written already, or the count works it out twice."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a local master gets a
    temporary folder of its own; on a cluster it is an error, since executors would not share the folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager)
