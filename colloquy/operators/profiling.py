"""Column profiles of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import sums_before

# Items that a sketch of frequent values tracks, and its error: with so many items of
# so many rows, an estimate is wrong by at most SKETCH_ERROR x rows / items (the sketch's published
# bound of 3.5 / table size, of which items fill three quarters).
TRACKED = 4096
SKETCH_ERROR = 2.625


def _as_text(value: str, kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    return f"CAST({value} AS STRING)"


def _counted_as(kind: T.DataType) -> str | None:
    """The type as which values are counted, or None where that is their text.

    Only types of which no two different values have one text, but for the sign of a zero.
    """
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DateType, T.TimestampNTZType)):
        return kind.simpleString()
    return None


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def profile_table(table: DataFrame, name: str, *, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, bounds.

    Bounds are doubles for numbers, text for the rest, NULL for nested values. Rows, nulls and bounds
    come from one pass with a fixed-size buffer per column; the distinct count
    is estimated in that pass. With ``exact`` it is counted in a second one, which
    shuffles a row for each distinct value.
    """
    aggregates, cells = ["count(1) AS rows"], []
    for i, field in enumerate(table.schema.fields):
        column, kind = _quoted(field.name), field.dataType
        ordered = _ordered(kind)
        aggregates += [
            f"count_if({column} IS NULL) AS nulls{i}",
            f"{f'min({column})' if ordered else 'NULL'} AS low{i}",
            f"{f'max({column})' if ordered else 'NULL'} AS high{i}",
        ]
        distinct = "CAST(NULL AS BIGINT)"
        if not exact:
            aggregates.append(f"approx_count_distinct({column}) AS distinct{i}")
            distinct = f"distinct{i}"
        number = isinstance(kind, T.NumericType)
        bounds = []
        for end, source in (("min", f"low{i}"), ("max", f"high{i}")):
            bounds.append(f"CAST({source if number else 'NULL'} AS DOUBLE) AS {end}_number")
            bounds.append(f"{'CAST(NULL AS STRING)' if number else _as_text(source, kind)} AS {end}_text")
        cells.append(
            f"struct({_literal(name)} AS table_name, {_literal(field.name)} AS column_name, "
            f"{_literal(kind.simpleString())} AS column_type, rows AS row_count, nulls{i} AS null_count, "
            f"{distinct} AS estimate, {', '.join(bounds)})"
        )
    profile = table.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(cells)}))")
    count = "estimate"
    if exact:
        profile = profile.join(_distinct_counts(table), "column_name", "left")
        count = "coalesce(n, 0L)"
    return profile.selectExpr(
        "table_name", "column_name", "column_type", "row_count", "null_count", f"{count} AS distinct_count",
        "min_number", "max_number", "min_text", "max_text",
    )


def _distinct_counts(table: DataFrame) -> DataFrame:
    """Distinct non-null values per column: column_name, n.

    The cells become (column, value) rows, made distinct before and after one
    shuffle. Texts are compared by their SHA-256, so that whole texts are not
    shuffled.
    """
    cells = []
    for field in table.schema.fields:
        column = _quoted(field.name)
        value = f"CAST({column} AS STRING)"
        if isinstance(field.dataType, T.StringType):
            value = f"sha2({column}, 256)"
        cells.append(f"struct({_literal(field.name)} AS column_name, {value} AS value)")
    return (
        table.selectExpr(f"inline(array({', '.join(cells)}))")
        .filter("value IS NOT NULL")
        .distinct()
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(
    table: DataFrame, name: str, columns: Sequence[str] | None = None, *, n: int = 5, tracked: int = TRACKED
) -> DataFrame:
    """The n most frequent non-null values of each column in turn, ties by value; no job per column.

    One pass keeps a sketch of frequent items of each column, by the values' hashes. Where it
    proves that the n most frequent values are among its items, a second pass counts these
    alone. Columns without such values (keys, free texts) have all their values counted in
    that pass. Nested columns are left out. No task sees all values of a column.
    """
    fields = [f for f in table.schema.fields if _ordered(f.dataType) and (columns is None or f.name in columns)]
    schema = "table_name string, column_name string, value string, frequency bigint"
    if not fields:
        return table.sparkSession.createDataFrame([], schema)
    kept = 10 * n + 100
    hashes = [f"xxhash64({_quoted(f.name)})" for f in fields]
    sketches = []
    for i, (field, digest) in enumerate(zip(fields, hashes)):
        sketches.append(f"count({_quoted(field.name)}) AS n{i}")
        item = f"CASE WHEN {_quoted(field.name)} IS NOT NULL THEN {digest} END"
        sketches.append(f"approx_top_k({item}, {kept}, {max(tracked, kept)}) AS items{i}")
    row = table.selectExpr(*sketches).first()
    cells: dict = {}
    for i, (field, digest) in enumerate(zip(fields, hashes)):
        column, kind = _quoted(field.name), _counted_as(field.dataType)
        items = [x for x in row[f"items{i}"] or () if x["item"] is not None]
        chosen = _surely_frequent(items, row[f"n{i}"], n, kept, max(tracked, kept))
        condition = f"{column} IS NOT NULL"
        if chosen is not None:
            condition += f" AND {digest} IN ({', '.join(map(str, chosen)) or 'NULL'})"
        value = f"CAST({column} AS {kind})" if kind else _as_text(column, field.dataType)
        # Zeros of both signs are equal, but their texts are not.
        minus = f", coalesce({column} = 0 AND CAST({column} AS STRING) LIKE '-%', false) AS minus" if kind in ("float", "double") else ""
        cells.setdefault(kind, []).append(f"struct({i} AS place, CASE WHEN {condition} THEN {value} END AS value{minus})")
    # One branch for each type: numbers are counted as such, and only different values become texts.
    parts = [_counted(table, kind, listed) for kind, listed in cells.items()]
    names = F.array(*[F.lit(f.name) for f in fields])
    counted = reduce(DataFrame.unionByName, parts).withColumn("column_name", F.get(names, F.col("place"))).drop("place")
    order = Window.partitionBy("column_name").orderBy(F.desc("frequency"), "value")
    first = counted.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= n)
    place = F.array_position(F.array(*[F.lit(c) for c in columns or [f.name for f in fields]]), F.col("column_name"))
    return first.orderBy(place, "_at").select(F.lit(name).alias("table_name"), "column_name", "value", "frequency")


def _counted(table: DataFrame, kind: str | None, cells: list[str]) -> DataFrame:
    """place, value (as text) and frequency of the values that some columns of one type have."""
    present = table.selectExpr(f"inline(array({', '.join(cells)}))").filter("value IS NOT NULL")
    counted = present.groupBy(*present.columns).agg(F.count(F.lit(1)).alias("frequency"))
    value = _as_text("value", T._parse_datatype_string(kind)) if kind else "value"
    if "minus" in present.columns:
        value = f"CASE WHEN minus THEN concat('-', {value}) ELSE {value} END"
    return counted.selectExpr("place", f"{value} AS value", "frequency")


def _surely_frequent(items: list, rows: int, n: int, kept: int, tracked: int) -> list[int] | None:
    """The hashes among which the n most frequent values are, or None if that is not sure.

    An estimate is never below the count and at most ``error`` above it, and a value that
    the sketch does not give has at most twice that count.
    """
    if len(items) < kept and sum(x["count"] for x in items) == rows:  # the sketch holds every value
        return [x["item"] for x in items]
    error = SKETCH_ERROR * rows / tracked
    if len(items) < n:
        return None
    least = items[n - 1]["count"] - error  # n values have this count or more
    if least <= 2 * error or (len(items) == kept and items[-1]["count"] >= least):
        return None
    return [x["item"] for x in items if x["count"] >= least]


def quartiles(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The exact quartiles of each numeric column of some tables: the least values that a quarter,
    half and three quarters of the non-null values do not exceed. NaN is the largest; NULL without values.

    Values are counted before they are sorted, all tables and columns at once over range
    partitions, so that no task sees a whole column and a frequent value is one row.
    """
    keys, listed, parts = ("table_name", "column_name"), [], []
    for name, table in tables.items():
        numbers = [f for f in table.schema.fields if isinstance(f.dataType, T.NumericType)]
        listed += [(name, f.name) for f in numbers]
        cells = [
            f"struct({_literal(name)} AS table_name, {_literal(f.name)} AS column_name, CAST({_quoted(f.name)} AS DOUBLE) AS value)"
            for f in numbers
        ]
        if cells:
            values = table.selectExpr(f"inline(array({', '.join(cells)}))").filter("value IS NOT NULL")
            parts.append(values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    if not parts:
        raise ValueError("the tables have no numeric column")
    placed = sums_before(reduce(DataFrame.unionByName, parts), "value", F.col("n"), by=keys)
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("total"))
    reach = F.col("before") + F.col("n")
    found = placed.join(F.broadcast(totals), list(keys)).groupBy(*keys).agg(
        *[F.min(F.when(4 * reach >= k * F.col("total"), F.col("value"))).alias(f"q{25 * k}") for k in (1, 2, 3)]
    )
    spark = placed.sparkSession
    return spark.createDataFrame(listed, "table_name string, column_name string").join(found, list(keys), "left")


def approximate_quartiles(table: DataFrame, name: str) -> DataFrame:
    """As :func:`quartiles`, from one mergeable KLL sketch of each column, in one pass without a sort.

    The sketches are randomised: a value's rank is wrong by about 1.3 % of the rows at most, in 99 of 100 cases.
    """
    numbers = [f for f in table.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numbers:
        return table.sparkSession.createDataFrame([], "table_name string, column_name string, q25 double, q50 double, q75 double")
    sketches = [f"kll_sketch_agg_double(CAST({_quoted(f.name)} AS DOUBLE)) AS s{i}" for i, f in enumerate(numbers)]
    counts = [f"count({_quoted(f.name)}) AS n{i}" for i, f in enumerate(numbers)]
    cells = []
    for i, f in enumerate(numbers):
        points = ", ".join(
            f"CASE WHEN n{i} > 0 THEN kll_sketch_get_quantile_double(s{i}, {k / 4}D) END AS q{25 * k}" for k in (1, 2, 3)
        )
        cells.append(f"struct({_literal(name)} AS table_name, {_literal(f.name)} AS column_name, {points})")
    return table.selectExpr(*sketches, *counts).selectExpr(f"inline(array({', '.join(cells)}))")
