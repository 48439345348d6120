"""Predicates on the request table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_period(df: DataFrame, year=None, month=None, day=None, hour=None) -> DataFrame:
    """Whole partitions. Values may be numbers or text, with or without a leading zero."""
    for name, value in (("year", year), ("month", month), ("day", day), ("hour", hour)):
        if value is not None:
            df = df.where(F.col(name) == int(value))
    return df


def _hour_number(moment: datetime) -> int:
    return ((moment.year * 100 + moment.month) * 100 + moment.day) * 100 + moment.hour


def where_time_range(df: DataFrame, start: datetime, end: datetime, column: str = "parsed_timestamp_apache",
                     slack: timedelta | None = None) -> DataFrame:
    """Rows with ``start <= column <= end``.

    The partitions stand for the syslog time, so a range on that column also
    prunes them. A range on the request time does so only if ``slack`` says how
    far the two times can be apart.
    """
    df = df.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if column == "parsed_timestamp_syslog":
        slack = timedelta(0)
    if slack is None or "hour" not in df.columns:
        return df
    number = ((F.col("year") * 100 + F.col("month")) * 100 + F.col("day")) * 100 + F.col("hour")
    return df.where(number.between(_hour_number(start - slack), _hour_number(end + slack)))


def errors(df: DataFrame) -> DataFrame:
    return df.where("is_error")


def is_level(level: str = "ERROR", column: str = "level") -> Column:
    return F.col(column) == level


def holds_word(word: str = "FAILED", column: str = "message") -> Column:
    return F.contains(F.col(column), F.lit(word))


def log_level(df: DataFrame, level: str = "ERROR", column: str = "level") -> DataFrame:
    """Service log records of one level."""
    return df.where(is_level(level, column))


def message_like(df: DataFrame, word: str = "FAILED", column: str = "message") -> DataFrame:
    """Service log records whose message holds a word, as in ``*FAILED*``."""
    return df.where(holds_word(word, column))


def level_and_word(df: DataFrame, level: str = "ERROR", word: str = "FAILED") -> DataFrame:
    """Service log records of one level whose message holds a word."""
    return df.where(is_level(level) & holds_word(word))
