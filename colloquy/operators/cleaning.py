"""Cleaning steps as data: each table has an ordered list of steps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a real client name looks like, and names known to be fake.
NAME_PATTERN = r"^[A-Za-z]+([ -][A-Za-z]+)*$"
FAKE_NAMES = ("A Z", "A Y")
SHORT_NAME_BYTES = 2

Step = tuple


def _known(frame: DataFrame, columns: Iterable[str]) -> None:
    unknown = sorted(set(columns) - set(frame.columns))
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")


def drop_columns(frame: DataFrame, *columns: str) -> DataFrame:
    _known(frame, columns)
    return frame.drop(*columns)


def rename_columns(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    _known(frame, names)
    return frame.withColumnsRenamed(dict(names))


def _delete(frame: DataFrame, key: str, condition: Column) -> DataFrame:
    """Delete rows with a positive key that meet the condition; an unknown condition keeps the row."""
    return frame.filter(~F.coalesce((F.col(key) > 0) & condition, F.lit(False)))


def delete_unmatched(frame: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _delete(frame, key, ~F.col(column).rlike(pattern))


def delete_short(frame: DataFrame, key: str, column: str, max_bytes: int) -> DataFrame:
    return _delete(frame, key, F.octet_length(column) <= max_bytes)


def delete_values(frame: DataFrame, key: str, column: str, values: Iterable[str]) -> DataFrame:
    return _delete(frame, key, F.col(column).isin(*values))


STEPS = {
    "drop": drop_columns,
    "rename": rename_columns,
    "delete_unmatched": delete_unmatched,
    "delete_short": delete_short,
    "delete_values": delete_values,
}

# The cleaning of each source table, in order.
CLEANING: Mapping[str, tuple[Step, ...]] = {
    "users": (
        ("drop", "email_verified_at", "phone", "dob", "photo"),
        ("rename", {"id": "user_id"}),
    ),
    "bot_user": (("drop", "created_at", "updated_at"),),
    "bots": (
        ("drop", "assistant_id", "vector_store_id", "thread_id"),
        ("rename", {"id": "bot_id"}),
    ),
    "categories": (("rename", {"id": "category_id"}),),
    "orders": (("rename", {"id": "order_id"}),),
    "order_items": (("drop", "special_instructions"),),
    "objects": (("rename", {"id": "object_id"}),),
    "companies": (("rename", {"id": "company_id"}),),
    "telescope_entries": (("drop", "family_hash"),),
    "clients": (
        ("rename", {"id": "client_id"}),
        ("delete_unmatched", "client_id", "name", NAME_PATTERN),
        ("delete_short", "client_id", "name", SHORT_NAME_BYTES),
        ("delete_values", "client_id", "name", FAKE_NAMES),
    ),
}


def clean(frame: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Apply steps, each a step name followed by its arguments."""
    for name, *arguments in steps:
        frame = frame.transform(STEPS[name], *arguments)
    return frame


def clean_tables(
    tables: Mapping[str, DataFrame], plan: Mapping[str, Iterable[Step]] = CLEANING
) -> dict[str, DataFrame]:
    """Clean every table that has a plan and pass the others through."""
    return {name: clean(table, plan.get(name, ())) for name, table in tables.items()}


def drop_empty_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: table for name, table in tables.items() if not table.isEmpty()}
