"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    partitions = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("colloquy")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="colloquy-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, folder: str) -> None:
    """Create a folder in whatever store its path names."""
    path, system = _path(spark, folder)
    system.mkdirs(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    path, system = _path(spark, path)
    return system.exists(path) and system.getFileStatus(path).isDirectory()


def release(spark: SparkSession, folder: str) -> None:
    """Delete a written intermediate; only folders under the shared one are."""
    path, system = _path(spark, folder)
    shared = _path(spark, shared_folder(spark))[0]
    if not path.toUri().getPath().startswith(shared.toUri().getPath().rstrip("/") + "/"):
        raise ValueError(f"{folder} is not an intermediate")
    system.delete(path, True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Write the frame as parquet in the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and lets later readers prune
    columns, which an RDD checkpoint does not.
    """
    spark = frame.sparkSession
    path = new_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
