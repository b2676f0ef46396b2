"""Reading tables and queries, and writing report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHATS, CLIENTS, conform
from ..session import is_folder


def read_source(
    spark: SparkSession,
    table: str | None = None,
    query: str | None = None,
    *,
    jdbc: Mapping[str, str] | None = None,
    folder: str | None = None,
    split: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """Read a table or a query's result; the query wins when both are given.

    ``jdbc`` holds the connection options (url, user, password, driver), which
    are never constants here. ``split`` = (column, lower, upper, partitions)
    reads a JDBC table or query in parallel. Without ``jdbc``, a table is
    ``<folder>/<table>.parquet`` and a query runs on the registered views.
    """
    if not table and not query:
        raise ValueError("give a table or a query")
    if jdbc is not None:
        return _jdbc_reader(spark, table, query, jdbc, split).load()
    if query:
        return spark.sql(query)
    if folder is None:
        raise ValueError("a table needs a folder or JDBC options")
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stream_source(spark: SparkSession, table: str, *, folder: str) -> DataFrame:
    """A stream of a parquet table's files: all part files of its folder, or its one file."""
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    # A single file can be watched by its folder only.
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def jdbc_options(table, query, jdbc, split=None) -> dict[str, str]:
    options = dict(jdbc)
    if query and split:
        # A partitioned read needs a relation, so the query becomes a subquery.
        options["dbtable"] = f"({query}) q"
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    if split:
        column, lower, upper, partitions = split
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def _jdbc_reader(spark, table, query, jdbc, split):
    return spark.read.format("jdbc").options(**jdbc_options(table, query, jdbc, split))


def read_chats(spark: SparkSession, **source) -> DataFrame:
    """Chats under their contract; created_at is parsed, and a bad value raises."""
    return conform(read_source(spark, **source), CHATS)


def read_clients(spark: SparkSession, **source) -> DataFrame:
    return conform(read_source(spark, **source), CLIENTS)


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Make tables visible to query reads by name."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def write_chats(chats: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write chats partitioned by date, which date filters then prune.

    Ranges of (date, id) give each task few dates and split a date that holds
    most rows over several tasks.
    """
    (
        chats.withColumn("date", F.to_date("created_at"))
        .repartitionByRange("date", "id")
        .write.mode(mode)
        .partitionBy("date")
        .parquet(path)
    )


def write_reports(
    reports: Mapping[str, DataFrame],
    folder: str,
    *,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write each report table as ``<folder>/<name>`` in parquet."""
    for name, report in reports.items():
        report.write.mode(mode).partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{folder}/{name}")
