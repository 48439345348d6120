"""Threshold alarms over windowed metrics.

An alarm is raised when its metric breaches the threshold in a number of
consecutive windows. All steps work on windows, of which there are as many as
the time range has periods, however many requests lie in them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.functions.timestamps import as_wall_time


@dataclass(frozen=True)
class Alarm:
    name: str
    description: str
    period: int
    """Length of a window in seconds."""
    periods: int
    """Consecutive windows that must breach."""
    threshold: float
    comparison: str
    """``above`` or ``below`` the threshold."""
    missing: str = "not breaching"
    """What a window without data counts as."""


# Thresholds and windows of the alarms in use.
ALARMS = {
    "no_data": Alarm("No-Incoming-Records", "No data for 10 minutes", 300, 2, 1.0, "below", "breaching"),
    "lag": Alarm("High-Iterator-Age", "Processing lags behind", 300, 2, 300000.0, "above"),
    "parse_errors": Alarm("Parse-Error-Rate", "Records cannot be parsed", 300, 2, 5.0, "above"),
    "response_time": Alarm("Average-Response-Time", "Responses are slow", 300, 3, 2000.0, "above"),
    "error_rate": Alarm("Error-Rate", "Many requests fail", 300, 2, 5.0, "above"),
    "pool_health": Alarm("Pool-Health-Score", "Pools are unhealthy", 600, 2, 70.0, "below"),
}


def window_start(time: str, alarm: Alarm) -> Column:
    return F.window(time, f"{alarm.period} seconds")["start"].alias("window_start")


def metric_windows(df: DataFrame, time: str, alarm: Alarm, value: Column, dimensions: list[str] | None = None) -> DataFrame:
    """``value``, an aggregate, per window and dimension."""
    return df.groupBy(window_start(time, alarm), *(dimensions or [])).agg(value.cast("double").alias("value"))


def arrival_lag(records: DataFrame, event: str, alarm: Alarm) -> DataFrame:
    """The lag alarm's windows: how far, in milliseconds, the newest record of a file lies behind the file's arrival.

    ``records`` carry ``file`` and ``arrived`` (``readers.lines_with_origin``); a window, of arrival times, takes its
    files' largest lag. Files without a timed record have none.
    """
    files = records.groupBy("file", "arrived").agg(F.max(event).alias("newest")).where("newest is not null")
    arrived = as_wall_time(F.col("arrived"))
    lag = F.timestamp_diff("MILLISECOND", F.col("newest"), F.col("seen"))
    return metric_windows(files.select("newest", arrived.alias("seen")), "seen", alarm, F.max(lag))


def _epoch(time: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def with_empty_windows(windows: DataFrame, alarm: Alarm, dimensions: list[str] | None = None,
                       start: str | None = None, end: str | None = None) -> DataFrame:
    """Add the windows nothing fell into, with a null value.

    They run from the first to the last window of each dimension, or between
    the given times. No window is built by a join of everything with everything:
    each dimension unrolls its own range.
    """
    dimensions = dimensions or []
    kind = dict(windows.dtypes)["window_start"]
    first = F.lit(start).cast(kind) if start else F.min("window_start")
    last = F.lit(end).cast(kind) if end else F.max("window_start")
    ranges = windows.groupBy(*dimensions).agg(first.alias("_first"), last.alias("_last")).where("_first <= _last")
    step = F.make_dt_interval(secs=F.lit(alarm.period))
    spine = ranges.select(*dimensions, F.explode(F.sequence("_first", "_last", step)).alias("window_start"))
    return spine.join(windows, ["window_start", *dimensions], "left")


def _breaches(value: Column, alarm: Alarm) -> Column:
    crossed = value > alarm.threshold if alarm.comparison == "above" else value < alarm.threshold
    return F.coalesce(crossed, F.lit(alarm.missing == "breaching"))


DAY = 86400


def _by_day(at: Column) -> Column:
    return F.floor(at / DAY)


def evaluate(windows: DataFrame, alarm: Alarm, dimensions: list[str] | None = None) -> DataFrame:
    """State of the alarm at the end of each window: ``ALARM`` or ``OK``.

    The frame is a range of time, so a window without data ends a run of
    breaches unless it has been added as breaching. Windows are judged day by
    day: the last ones of a day also go to the next, where they only count.
    """
    keys, reach = list(dimensions or []), (alarm.periods - 1) * alarm.period
    judged = windows.withColumn("_at", _epoch(F.col("window_start"))).withColumn("breaching", _breaches(F.col("value"), alarm))
    own = _by_day(F.col("_at"))
    judged = judged.withColumn("_day", F.explode(F.sequence(own, _by_day(F.col("_at") + reach))))
    frame = Window.partitionBy(*keys, "_day").orderBy("_at").rangeBetween(-reach, 0)
    judged = judged.withColumn("datapoints_breaching", F.sum(F.col("breaching").cast("int")).over(frame))
    state = F.when(F.col("datapoints_breaching") >= alarm.periods, "ALARM").otherwise("OK")
    return judged.where(F.col("_day") == own).withColumn("state", state).drop("_at", "_day")


def _reason(alarm: Alarm) -> Column:
    """Why the state changed, with the latest datapoint."""
    word = {"above": "greater", "below": "less"}[alarm.comparison]
    shown = F.coalesce(F.round("value", 2).cast("string"), F.lit("no data"))
    stamp = F.date_format("window_start", "dd/MM/yy HH:mm:ss")
    crossed = F.when(F.col("breaching"), "was").otherwise("was not")
    return F.concat(
        F.lit("Threshold Crossed: "), F.col("datapoints_breaching").cast("string"),
        F.lit(f" out of the last {alarm.periods} datapoints ["), shown, F.lit(" ("), stamp, F.lit(")] "), crossed,
        F.lit(f" {word} than the threshold ({alarm.threshold})."),
    )


def transitions(states: DataFrame, alarm: Alarm, dimensions: list[str] | None = None,
                initial: str = "OK") -> DataFrame:
    """One row for each change of state, with the reason as text."""
    dimensions = dimensions or []
    judged = states.withColumn("_day", _by_day(_epoch(F.col("window_start"))))
    order = Window.partitionBy(*dimensions, "_day").orderBy("window_start")
    judged = judged.withColumn("old_state", F.lag("state").over(order))
    # A day's first window follows the last one of the latest day that has any: one row a day.
    days = judged.groupBy(*dimensions, "_day").agg(F.max_by("state", "window_start").alias("_state"))
    over_days = Window.partitionBy(*dimensions).orderBy("_day")
    renamed = {c: f"_of_{i}" for i, c in enumerate([*dimensions, "_day"])}
    before = days.withColumn("_before", F.lag("_state").over(over_days)).drop("_state").withColumnsRenamed(renamed)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in renamed.items()]
    judged = judged.join(before, reduce(Column.__and__, same), "left").withColumn("old_state", F.coalesce("old_state", "_before", F.lit(initial)))
    return named_transitions(judged.where("old_state <> state"), alarm, dimensions)


def named_transitions(changed: DataFrame, alarm: Alarm, dimensions: list[str]) -> DataFrame:
    """Judged windows at which the state changed, with the alarm's name and the reason."""
    return changed.select(
        F.lit(alarm.name).alias("alarm_name"),
        F.lit(alarm.description).alias("alarm_description"),
        *dimensions,
        "old_state",
        F.col("state").alias("new_state"),
        _reason(alarm).alias("reason"),
        (F.col("window_start") + F.make_dt_interval(secs=F.lit(alarm.period))).alias("state_change_time"),
    )
