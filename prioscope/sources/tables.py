"""Stage tables: Parquet between the steps of a run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Rows of a task at most, and so many that a further task is worth its start.
TASK_ROWS = 50_000
LEAST_ROWS = 4_000


def work_folder(spark: SparkSession) -> str:
    """The shared folder the session names for checkpoints.

    Only a local session without one gets a temporary folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="prioscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows as a Parquet table in the work folder and read them from there.

    Later steps scan the table, whatever executors are lost, instead of
    repeating the work behind it.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def balanced(df: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """The rows of a stage table over enough tasks: on every core, and at most about `most` rows in one.

    Splits of files go by bytes, so rows that compress well would meet in a few tasks
    however many there are. Tables with enough splits, or few rows, stay as they are.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    wanted = max(-(-rows // most), min(cores, rows // LEAST_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
