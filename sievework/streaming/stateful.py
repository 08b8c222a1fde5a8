"""Streams with state of their own: resumable generation and a log watcher that notices silence.

State lives in Spark's state store, keyed and checkpointed, so that a micro-batch costs what it brings, whatever the sink
or the history holds, and a query started again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_NO_EMPTY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings that a query started within takes along."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Resume(StatefulProcessor):
    """Passes a key's first row on and remembers the key for a while."""

    def __init__(self, order: str, columns: list[str], ttl_ms: int):
        self.order, self.columns, self.ttl_ms = order, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "repeats bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, n = None, 0
        for row in rows:
            n += 1
            at = row[self.order]
            if first is None or (at is not None and (first[self.order] is None or at < first[self.order])):
                first = row
        if first is None:
            return
        had = self.done.get()
        if had is not None:
            self.done.update((had[0] + n,))
            return
        self.done.update((n - 1,))
        yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


def resume(stream: DataFrame, key: list[str], order: str, ttl_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:  # ST2
    """Of each key the first row that arrives (of one micro-batch, the one of the least ``order``); later ones are work
    done already. A key is forgotten ``ttl_ms`` of processing time after it last came (0: never), so state does not grow for ever."""
    made = _Resume(order, stream.columns, ttl_ms)
    return stream.groupBy(*key).transformWithState(statefulProcessor=made, outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime")


REPORT = T.StructType([T.StructField(n, t) for n, t in (("run", T.StringType()), ("kind", T.StringType()), ("status", T.StringType()), ("step", T.StringType()), ("lines", T.LongType()), ("at", T.TimestampType()))])


class _Watch(StatefulProcessor):
    """Progress of a run, and a timer that goes off when it says nothing for a while."""

    def __init__(self, silence_ms: int, over: list[str]):
        self.silence_ms, self.over = silence_ms, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, step string, lines bigint, at bigint, timer bigint")

    def _report(self, run: str, kind: str, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(run, kind, state[0], state[1], state[2], pd.Timestamp(state[3], unit="ms"))], columns=REPORT.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else (None, None, 0, -1, -1)
        status, step, lines, at, timer = old
        for part in rows:
            lines += len(part)
            for r in part.sort_values(["at", "line"]).itertuples():
                when = int(r.at.timestamp() * 1000)
                if when >= at:
                    at, status, step = when, r.status or status, r.step or step
        if timer >= 0:
            self.handle.deleteTimer(timer)
        over = status in self.over
        timer = -1 if over else at + self.silence_ms
        if not over:
            self.handle.registerTimer(timer)
        state = (status, step, lines, at, timer)
        self.last.update(state)
        kind = "over" if over else "back" if old[4] == -1 and old[2] > 0 and old[0] not in self.over else "progress"
        yield self._report(key[0], kind, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, step, lines, at, _ = self.last.get()
        state = (status, step, lines, at, -1)
        self.last.update(state)
        yield self._report(key[0], "silent", state)

    def close(self) -> None:
        pass


def watch(lines: DataFrame, silence: str = "30 minutes", late: str = "10 minutes", over: tuple[str, ...] = ("complete", "failed")) -> DataFrame:  # ST3
    """Reports from log lines '<time> <run> step=<s> status=<x>' (a column ``value``): a row for a run in each micro-batch that
    brings lines of it (progress; over, if its last status ends it; back, if it had been silent), and one when the log's time
    goes ``silence`` beyond its last line: silent. Lines more than ``late`` behind the newest are dropped, lines a little late
    count but never set a run back."""
    word = lambda name: F.nullif(F.regexp_extract("value", rf"{name}=(\S+)", 1), F.lit(""))
    parsed = lines.select(F.try_to_timestamp(F.regexp_extract("value", r"^(\S+)", 1)).alias("at"), F.regexp_extract("value", r"^\S+ (\S+)", 1).alias("run"), word("step").alias("step"), word("status").alias("status"), F.col("value").alias("line"))
    made = _Watch(int(pd.Timedelta(silence).total_seconds() * 1000), list(over))
    kept = parsed.where("at IS NOT NULL AND run <> ''").withWatermark("at", late)
    return kept.groupBy("run").transformWithStateInPandas(statefulProcessor=made, outputStructType=REPORT, outputMode="Append", timeMode="EventTime")


def to_files(stream: DataFrame, sink: str, checkpoint: str, timers: bool = False) -> StreamingQuery:
    """All that is there now, appended to Parquet files exactly once; to be run again with the same checkpoint. State is
    kept in RocksDB: it may outgrow an executor's memory. ``timers``: the query has event-time timers, which go off
    in a batch without rows at the end. Without them there is none: state with a time to live would ask for one for ever."""
    with settings(stream.sparkSession, _STORE if timers else _STORE | _NO_EMPTY):
        return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
