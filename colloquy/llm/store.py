"""Small Spark helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# A table of narrow rows is broadcast only when it is counted to hold no more
# rows than this; beyond, the join is left to Spark, which shuffles both sides.
BROADCAST_ROWS = 500_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_broadcast(table: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a table counted to be small, else give it back as it is."""
    rows = table.count() if rows is None else rows
    return F.broadcast(table) if rows <= limit else table


def give_back() -> None:
    """Return what this worker has freed to the system: it lives on and serves other stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow after which the worker holds no more memory than before the task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark context.

    Rows of texts are large, so they go to the workers in smaller batches than Spark's default;
    another number that the session sets stays.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    context = spark.sparkContext
    if getattr(context, "_colloquy_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="colloquy-")) / "colloquy.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "colloquy").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    context._colloquy_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fields(frame: DataFrame, *added: tuple[str, str]) -> T.StructType:
    """The frame's schema and more fields, given as (name, type in DDL)."""
    types = {name: T._parse_datatype_string(kind) for name, kind in added}
    return T.StructType(
        list(frame.schema.fields) + [T.StructField(name, kind, True) for name, kind in types.items()]
    )


def unused(columns: Iterable[str], name: str) -> str:
    """The name, with underscores after it until no column has it."""
    columns = set(columns)
    while name in columns:
        name += "_"
    return name


def batches_of(rows: Iterable, size: int):
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


__all__ = ["BROADCAST_ROWS", "batches_of", "bounded_broadcast", "fields", "give_back", "lean", "ship_package", "table", "unused", "written"]
