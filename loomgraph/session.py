"""Session and storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a task in dealt().
ROWS = 500_000


def local_session(name: str = "loomgraph", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and laptops; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the folder of spark.checkpoint.dir (a temporary one only where unset, on one machine)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffles on either side, up to the next join above it.

    For rows that grow with the input but seem few: what an explode makes of a small table is taken to be no larger than
    the table, and compressed shuffles look small, so that Spark would send millions of rows through the driver.
    """
    return df.hint("shuffle_merge")


def tasks_for(spark: SparkSession, rows: float, each: int = ROWS) -> int:
    """Tasks of about `each` rows, as many as there are cores at least."""
    return int(max(spark.sparkContext.defaultParallelism, min(2000, -(-rows // each))))


def dealt(df: DataFrame, *keys: str, each: int = ROWS) -> DataFrame:
    """df shuffled by the keys into tasks of about `each` rows, which are counted first.

    Spark merges the tasks of other shuffles until a few are left, by their compressed size, so that what one of them holds
    follows the input.
    """
    return df.repartition(tasks_for(df.sparkSession, df.count(), each), *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, for a query that writes and reads again."""
    shared_checkpoint(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
