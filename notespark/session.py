"""Session helpers shared by operators that need cluster-wide scratch space."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the session names; without one it is an error, since a folder of one machine's own
    would be lost with that machine. Programs that run on one machine name one themselves (``local_session``)."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(folder)


def name_local_checkpoint_dir(spark: SparkSession) -> None:
    """Give a session of one process, and only such a one, a temporary checkpoint folder if it has none."""
    context = spark.sparkContext
    unset = not context.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None)
    if unset and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="notespark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the returned frame always reads the same rows in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate rows that is not read any more, by Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query within go as soon as it has ended, not when the driver happens to collect its garbage.
    For frames that are executed once; executed again, they shuffle anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# What the operators assume of a session. Sizes are per task or per join side, so they hold on any cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# The given tables are single row groups, which one task reads. Set, this setting spreads them over so many tasks.
SPREAD = "spark.notespark.input.partitions"


def local_session(cpus: int, memory: str = "12g") -> SparkSession:
    """Single-process session for tests and timing."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("notespark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config(SPREAD, str(cpus))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    name_local_checkpoint_dir(spark)
    return spark
