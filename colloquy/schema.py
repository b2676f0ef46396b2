"""Column contracts of the two core tables, checked when a table is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHATS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("client_id", T.LongType(), True),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("question", T.StringType(), True),
        T.StructField("answer", T.StringType(), True),
    ]
)

CLIENTS = T.StructType(
    [
        T.StructField("client_id", T.LongType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)


def conform(frame: DataFrame, contract: T.StructType) -> DataFrame:
    """Cast the contract's columns and keep the others as they are.

    A missing column raises here; a value that cannot be cast raises when the
    frame is run (ANSI casts).
    """
    missing = [f.name for f in contract if f.name not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wanted = [F.col(f.name).cast(f.dataType).alias(f.name) for f in contract]
    extra = [c for c in frame.columns if c not in contract.names]
    return frame.select(*wanted, *extra)
