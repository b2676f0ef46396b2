"""Session numbers of every message of a stream.

A message can be numbered once no earlier one of its client can come, which is when
the watermark has passed it. Until then it waits in the client's state; a timer at
the earliest waiting message then numbers, in the order of time and id, all that
the watermark has passed. The state of a client is its waiting messages (bounded by the
watermark's delay) and, for the sessions, the time and number of the last one: nothing that
grows with the stream. Needs the RocksDB state store, which :func:`with_state_store` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.timeline import GAP_MINUTES
from ..session import make_folder, new_folder
from .reports import CLOSING_CLIENT, CLOSING_TIME, _with_event_time, stream_to_table

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "id bigint, client_id bigint, at bigint, session_id bigint, late boolean"


@contextmanager
def with_state_store(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


class SessionNumbers(StatefulProcessor):
    """Numbers the messages of one client; times are microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint")
        self.last = handle.getValueState("last", "at bigint, session_id bigint")
        self.timer = handle.getValueState("timer", "expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        earliest = None
        for batch in rows:
            late = batch["at"] < passed
            if late.any():
                yield self._rows(key, batch.loc[late, "at"], batch.loc[late, "id"], None, True)
            new = batch.loc[~late, ["at", "id"]]
            if len(new):
                self.waiting.appendList(list(new.itertuples(index=False, name=None)))
                first = int(new["at"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake_up_after(earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = pd.DataFrame(self.waiting.get(), columns=["at", "id"])
        ready = waiting["at"] < passed
        rest = waiting[~ready]
        if len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
            self._wake_up_after(int(rest["at"].min()))
        else:
            self.waiting.clear()
        ready = waiting[ready].sort_values(["at", "id"])
        if not len(ready):
            return
        before = ready["at"].shift()
        number = 0
        if self.last.exists():
            at, number = self.last.get()
            before.iloc[0] = at
        starts = ~(ready["at"] - before <= self.gap)  # also where there is none before
        numbers = number + starts.cumsum()
        self.last.update((int(ready["at"].iloc[-1]), int(numbers.iloc[-1])))
        yield self._rows(key, ready["at"], ready["id"], numbers, False)

    def _wake_up_after(self, at: int) -> None:
        expires = at // 1000 + 1  # the first millisecond that lies after the message
        if self.timer.exists():
            (earlier,) = self.timer.get()
            if earlier <= expires:
                return
            self.handle.deleteTimer(earlier)
        self.handle.registerTimer(expires)
        self.timer.update((expires,))

    def _rows(self, key, at, ids, numbers, late: bool) -> pd.DataFrame:
        numbers = pd.array([None] * len(at), "Int64") if numbers is None else numbers.astype("Int64")
        columns = {"id": ids, "client_id": key[0], "at": at, "session_id": numbers, "late": late}
        return pd.DataFrame({name: pd.Series(value, index=at.index) for name, value in columns.items()})

    def close(self) -> None:
        pass


def streaming_session_ids(chats: DataFrame, *, gap_minutes: int = GAP_MINUTES, delay: str = "1 hour") -> DataFrame:
    """id, client_id, created_at, session_id and late of every message, for append mode.

    The numbers are those of :func:`..operators.timeline.sessionize` on all messages that
    were not late. A late message, one that the watermark had passed when it came, is given
    out with no number instead of being dropped. So is one without a client, at once.
    """
    kept = chats.select("id", "client_id", "created_at")
    timed = _with_event_time(kept.filter(F.col("client_id").isNotNull()), delay)
    # Microseconds carry no watermark, so that Spark does not drop late rows unseen.
    numbered = (
        timed.select("id", "client_id", F.unix_micros("created_at").alias("at"))
        .groupBy("client_id")
        .transformWithStateInPandas(SessionNumbers(gap_minutes * 60_000_000), NUMBERED, "Append", "EventTime")
        .filter(F.col("client_id") != CLOSING_CLIENT)
    )
    time = F.timestamp_micros("at").cast("timestamp_ntz").alias("created_at")
    numbered = numbered.select("id", "client_id", time, "session_id", "late")
    nobody = kept.filter(F.col("client_id").isNull()).select(
        "id", "client_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("bigint").alias("session_id"), F.lit(False).alias("late"),
    )
    return numbered.unionByName(nobody)


def all_session_ids(
    chats: DataFrame, folder: str, *, checkpoint: str, gap_minutes: int = GAP_MINUTES, delay: str = "1 hour"
) -> DataFrame:
    """Every message of a stream that has ended, with its session's number.

    As with :func:`.reports.all_sessions`, a row of a reserved client far in the future,
    in a source beside the stream, lets the watermark pass the last messages.
    """
    spark = chats.sparkSession
    columns = ("id", "client_id", "created_at")
    chats = chats.select(*columns)
    closing = new_folder(spark, "closing")
    make_folder(spark, closing)
    beside = spark.readStream.schema(chats.schema).parquet(closing)
    report = streaming_session_ids(chats.unionByName(beside), gap_minutes=gap_minutes, delay=delay)
    values = {"id": F.lit(None), "client_id": F.lit(CLOSING_CLIENT), "created_at": F.lit(CLOSING_TIME)}
    row = spark.range(1).select(*[values[c].cast(chats.schema[c].dataType).alias(c) for c in columns])
    with with_state_store(spark):
        stream_to_table(report, folder, checkpoint=checkpoint)
        row.write.mode("append").parquet(closing)
        stream_to_table(report, folder, checkpoint=checkpoint)
    return spark.read.schema(report.schema).parquet(folder)
