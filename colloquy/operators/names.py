"""Client names on per-client results and on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import HOT_ROWS, broadcast_if_small, find_hot_keys, hot_side, small_enough

NULL_LANES = 256


def unique_names(clients: DataFrame) -> DataFrame:
    """client_id and name; a client_id that occurs twice raises when the result is run."""
    duplicate = F.raise_error(F.concat(F.lit("client_id is not unique: "), F.col("client_id").cast("string")))
    return (
        clients.filter(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(F.max("name").alias("_name"), F.count(F.lit(1)).alias("_rows"))
        .select("client_id", F.when(F.col("_rows") > 1, duplicate.cast("string")).otherwise(F.col("_name")).alias("name"))
    )


def with_names(per_client: DataFrame, clients: DataFrame) -> DataFrame:
    """Names for a table that holds each client once, so no key is hot.

    Spark broadcasts the names only if it finds them small enough.
    """
    return per_client.join(unique_names(clients), "client_id", "left")


def with_names_on_rows(rows: DataFrame, clients: DataFrame, *, max_rows: int = HOT_ROWS) -> DataFrame:
    """Names for a table in which a client, or no client, may hold most rows.

    Left alone if it has names. Small client tables are broadcast. For large
    ones the rows of hot clients join the few names they need by broadcast, the
    other rows shuffle, and rows without a client are spread over lanes instead
    of meeting in one partition.
    """
    if "name" in rows.columns:
        return rows
    names = unique_names(clients)
    if small_enough(clients):
        return rows.join(F.broadcast(names), "client_id", "left")
    hot = find_hot_keys(rows, "client_id", max_rows)
    if hot is None:
        return _shuffled(rows, names)
    keys = hot_side(hot)
    hot_names = names.join(keys, "client_id", "left_semi")
    is_hot = rows.join(keys, "client_id", "left_semi").join(broadcast_if_small(hot_names), "client_id", "left")
    return _shuffled(rows.join(keys, "client_id", "left_anti"), names).unionByName(is_hot)


def _shuffled(rows: DataFrame, names: DataFrame) -> DataFrame:
    lane = F.when(F.col("client_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(NULL_LANES)) + 1).otherwise(F.lit(0))
    return (
        rows.withColumn("_lane", lane.cast("long"))
        .join(names.withColumn("_lane", F.lit(0).cast("long")), ["client_id", "_lane"], "left")
        .drop("_lane")
    )
