"""Previous and next rows of a client, and sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import HOT_ROWS, HotKeys, find_hot_keys, hot_side
from ..functions.times import micros, seconds_between
from ..session import written

KEY = "client_id"
ORDER = ("created_at", "id")
GAP_MINUTES = 30


def with_neighbors(
    rows: DataFrame,
    shifts: Mapping[str, tuple[str, int]],
    *,
    key: str = KEY,
    order: Sequence[str] = ORDER,
    keep_keyless: bool = False,
    max_rows: int = HOT_ROWS,
    hot: HotKeys | None | str = "find",
) -> DataFrame:
    """Add columns taken from the row before (-1) or after (+1) of the same key.

    ``shifts`` maps a new column to (column, -1 or +1). ``order`` must be unique
    within a key. Rows without a key have no neighbours: they are left out, or
    with ``keep_keyless`` kept with NULLs.

    Keys of ordinary size take one window over the key. A key with more than
    ``max_rows`` rows does not fit one task: its rows are range-partitioned by
    (key, order) into slices of even size, written once so that the slices are
    stable, windowed within a slice, and the outermost rows of each slice take
    their neighbour from a small table of slice edges. ``hot`` passes on the
    result of find_hot_keys when it is known already.
    """
    if hot == "find":
        hot = find_hot_keys(rows, key, max_rows)
    keyed = rows.filter(F.col(key).isNotNull())
    if hot is None:
        result = _shifted(keyed, shifts, [key], order)
    else:
        cold = keyed.join(hot_side(hot), key, "left_anti")
        result = _shifted(cold, shifts, [key], order).unionByName(_shifted_hot(keyed, hot, shifts, key, order))
    if keep_keyless:
        result = result.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
    return result.select(*rows.columns, *shifts)


def _shifted(rows, shifts, partition, order):
    w = Window.partitionBy(*partition).orderBy(*order)
    moved = {-1: F.lag, 1: F.lead}
    return rows.select("*", *[moved[step](source).over(w).alias(name) for name, (source, step) in shifts.items()])


def _shifted_hot(keyed: DataFrame, hot: HotKeys, shifts, key, order) -> DataFrame:
    sliced = written(
        keyed.join(hot_side(hot), key, "left_semi")
        .repartitionByRange(hot.slices, key, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    sources = sorted({source for source, _ in shifts.values()} - set(order))
    edge = F.struct(*order, *sources)
    along = Window.partitionBy(key).orderBy("_slice")
    # One row per slice and hot key: at most slices + keys rows, so broadcast.
    edges = (
        sliced.groupBy(key, "_slice")
        .agg(F.min(edge).alias("_first"), F.max(edge).alias("_last"))
        .select(key, "_slice", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    )
    within = Window.partitionBy(key, "_slice").orderBy(*order)
    inner = _shifted(sliced, shifts, [key, "_slice"], order).select(
        "*",
        F.lag(F.lit(True)).over(within).isNull().alias("_opens"),
        F.lead(F.lit(True)).over(within).isNull().alias("_closes"),
    )
    joined = inner.join(F.broadcast(edges), [key, "_slice"], "left")
    outer = {-1: ("_opens", "_before"), 1: ("_closes", "_after")}
    for name, (source, step) in shifts.items():
        at_edge, carried = outer[step]
        joined = joined.withColumn(name, F.when(F.col(at_edge), F.col(carried)[source]).otherwise(F.col(name)))
    return joined.select(*keyed.columns, *shifts)


def starts_session(prev_time, time, gap_minutes: float = GAP_MINUTES):
    """True on the first row of a session: no row before, or a longer gap than allowed."""
    return prev_time.isNull() | (seconds_between(prev_time, time) > gap_minutes * 60)


def _cell(gap_minutes: float):
    """Start of the time cell, as wide as the gap, that holds the row."""
    time, width = micros("created_at"), F.lit(int(gap_minutes * 60_000_000))
    return time - F.pmod(time, width)


def _session_cells(chats: DataFrame, gap_minutes: float) -> DataFrame:
    """Messages counted in time cells as wide as the session gap, with session ids.

    Two rows in one cell are closer than the gap, so a session never breaks
    inside a cell and the first, last and count of each cell are enough. Cells
    are cut at midnight, so that each lies on one date. They are aggregated
    before the shuffle, and a client has at most (time span / gap) of them and
    one more per date, however many rows it has.
    """
    cells = (
        chats.filter(F.col(KEY).isNotNull())
        .groupBy(KEY, _cell(gap_minutes).alias("_cell"), F.to_date("created_at").alias("_date"))
        .agg(
            F.min("created_at").alias("_first"),
            F.max("created_at").alias("_last"),
            F.count(F.lit(1)).alias("_messages"),
            F.count("question").alias("_questions"),
        )
    )
    w = Window.partitionBy(KEY).orderBy("_first")
    starts = starts_session(F.lag("_last").over(w), F.col("_first"), gap_minutes).cast("long")
    new_date = F.coalesce(F.lag("_date").over(w) != F.col("_date"), F.lit(True)).cast("long")
    return (
        cells.withColumn("_start", starts)
        .withColumn("_new_date", new_date)
        .withColumn("session_id", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )


def session_lengths(chats: DataFrame, *, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """One row per session of a client, numbered from 1; rows without client drop."""
    return (
        _session_cells(chats, gap_minutes)
        .groupBy(KEY, "session_id")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("session_end"),
            F.sum("_messages").alias("messages"),
        )
        .withColumn("session_length_min", seconds_between("session_start", "session_end") / 60)
    )


def client_activity(chats: DataFrame, *, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Questions, active dates, sessions and mean session length per client.

    All four come from the cells: one pass over the rows, and no shuffle after
    the one that brings a client's cells together.
    """
    length = seconds_between(F.min("_first"), F.max("_last")) / 60
    return (
        _session_cells(chats, gap_minutes)
        .groupBy(KEY, "session_id")
        .agg(F.sum("_questions").alias("q"), F.sum("_new_date").alias("d"), length.alias("length"))
        .groupBy(KEY)
        .agg(
            F.sum("q").alias("message_count"),
            F.sum("d").alias("active_days"),
            F.count(F.lit(1)).alias("sessions"),
            F.avg("length").alias("mean_session_min"),
        )
    )


def avg_session_length(chats: DataFrame, *, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Mean session length in minutes; a session of one message counts as 0."""
    return session_lengths(chats, gap_minutes=gap_minutes).agg(
        F.avg("session_length_min").alias("avg_session_length_min"), F.count(F.lit(1)).alias("sessions")
    )


def sessionize(chats: DataFrame, *, gap_minutes: float = GAP_MINUTES, max_rows: int = HOT_ROWS) -> DataFrame:
    """Add prev_time, gap (minutes) and session_id to every row.

    Rows without a client keep NULLs. Without hot clients everything is one
    window per client; with hot clients the ids come from the session cells by
    an equi-join on the cell.
    """
    hot = find_hot_keys(chats, KEY, max_rows)
    if hot is None:
        w = Window.partitionBy(KEY).orderBy(*ORDER)
        start = starts_session(F.col("prev_time"), F.col("created_at"), gap_minutes).cast("long")
        rows = (
            chats.filter(F.col(KEY).isNotNull())
            .withColumn("prev_time", F.lag("created_at").over(w))
            .withColumn("session_id", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        )
    else:
        cells = _session_cells(chats, gap_minutes).select(KEY, "_cell", "_date", "session_id")
        rows = (
            with_neighbors(chats, {"prev_time": ("created_at", -1)}, hot=hot)
            .withColumn("_cell", _cell(gap_minutes))
            .withColumn("_date", F.to_date("created_at"))
            .join(cells, [KEY, "_cell", "_date"], "left")
        )
    rows = rows.withColumn("gap", seconds_between("prev_time", "created_at") / 60).select(
        *chats.columns, "prev_time", "gap", "session_id"
    )
    return rows.unionByName(chats.filter(F.col(KEY).isNull()), allowMissingColumns=True)
