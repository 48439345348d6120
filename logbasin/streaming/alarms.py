"""Alarms as they happen: transitions of state on a stream, silence included.

Rows are added up per window and dimension first (partly in each task, so a busy dimension is no hot key); each window
goes on once the watermark has passed its end. What follows keeps a few numbers per dimension: the last window judged,
whether the latest ones breached, and the alarm's state. Where missing data breaches, a timer on event time judges the
windows that no row fell into, so silence raises the alarm without a row. The transitions are those of
``operators.alarms`` over the same windows, wherever runs begin and end; rows later than the watermark are counted in the
query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from logbasin.functions.timestamps import as_wall_time
from logbasin.operators.alarms import Alarm, named_transitions

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "start long, value double, breaching boolean, datapoints_breaching int, old_state string, state string"


class Judge(StatefulProcessor):
    """One alarm of one dimension: windows in order of time in, changes of state out."""

    def __init__(self, alarm: Alarm, keys: list[str], initial: str):
        self.alarm, self.initial = alarm, initial
        self.names = [*keys, *[c.split()[0] for c in CHANGE.split(", ")]]
        self.fills = alarm.missing == "breaching"

    def init(self, handle) -> None:
        self.handle = handle
        # The last window judged, the breaches of the latest ones as text of 0 and 1, the alarm's state.
        self.held = handle.getValueState("alarm", "start long, latest string, state string")

    def _judged(self, key: tuple, start: int, value: float | None, held: tuple | None) -> tuple[tuple, Row | None]:
        alarm = self.alarm
        breaching = self.fills if value is None else (value > alarm.threshold if alarm.comparison == "above" else value < alarm.threshold)
        last, latest, state = held or (start, "", self.initial)
        # Windows without data stand for no breach; those that do breach are judged before.
        gap = min((start - last) // alarm.period - 1, alarm.periods) if held else 0
        latest = (latest + "0" * gap + str(int(breaching)))[-alarm.periods :]
        found = latest.count("1")
        new = "ALARM" if found >= alarm.periods else "OK"
        change = Row(*self.names)(*key, start, value, breaching, found, state, new) if new != state else None
        return (start, latest, new), change

    def _upto(self, key: tuple, end: int, held: tuple) -> Iterator[tuple[tuple, Row | None]]:
        """Judge the empty windows behind the last one, before ``end``."""
        while self.fills and held[0] + self.alarm.period < end:
            held, change = self._judged(key, held[0] + self.alarm.period, None, held)
            yield held, change

    def _wait(self, held: tuple) -> None:
        """Look again when the next window has ended."""
        if self.fills:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[0] + 2 * self.alarm.period) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get() if self.held.exists() else None
        for start, value in sorted((r["start"], r["value"]) for r in rows):
            if held and start <= held[0]:
                continue
            for held, change in self._upto(key, start, held) if held else ():
                if change:
                    yield change
            held, change = self._judged(key, start, value, held)
            if change:
                yield change
        if held:
            self.held.update(held)
            self._wait(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        ended = timerValues.getCurrentWatermarkInMs() // 1000 - self.alarm.period
        for held, change in self._upto(key, ended + 1, held):
            if change:
                yield change
        self.held.update(held)
        self._wait(held)

    def close(self) -> None:
        pass


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Timers need this store; a query keeps the setting that it was started with."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def transitions(rows: DataFrame, time: str, alarm: Alarm, value: Column, dimensions: list[str] | None = None,
                delay: str = "10 minutes", initial: str = "OK") -> DataFrame:
    """The stream of an alarm's changes of state. ``time`` is an instant, ``value`` an aggregate over a window's rows."""
    dimensions = dimensions or []
    windows = rows.withWatermark(time, delay).groupBy(F.window(time, f"{alarm.period} seconds").alias("window"), *dimensions).agg(
        value.cast("double").alias("value")
    )
    keyed = windows.select(F.lit(alarm.name).alias("alarm"), *dimensions, F.unix_seconds("window.start").alias("start"), "value", "window")
    types = dict(rows.dtypes)
    keys = ", ".join(["alarm string", *[f"{d} {types[d]}" for d in dimensions]])
    changes = keyed.groupBy("alarm", *dimensions).transformWithState(Judge(alarm, ["alarm", *dimensions], initial), f"{keys}, {CHANGE}", "append", "eventTime")
    return named_transitions(changes.withColumn("window_start", as_wall_time(F.timestamp_seconds("start"))), alarm, dimensions)


def alarm_changes(rows: DataFrame, time: str, alarm: Alarm, value: Column, path: str, checkpoint: str, trigger: dict | None = None,
                  dimensions: list[str] | None = None, delay: str = "10 minutes") -> StreamingQuery:
    """Write an alarm's changes of state as Parquet, each exactly once."""
    with _state_in_rocksdb(rows.sparkSession):
        return (
            transitions(rows, time, alarm, value, dimensions, delay)
            .writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"processingTime": "60 seconds"}))
            .start()
        )
