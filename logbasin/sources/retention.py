"""Expiry of old partitions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession

KEEP_DAYS = 180


def _folders(fs, path) -> list:
    return [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]


def _value(path) -> int | None:
    """The number in a ``name=number`` folder; null partitions have none."""
    text = path.getName().partition("=")[2]
    return int(text) if text.isdigit() else None


def expire(spark: SparkSession, path: str, today: date, keep_days: int = KEEP_DAYS) -> list[str]:
    """Delete the day folders of a table that are older than ``keep_days``.

    Works on folders laid out as ``year=/month=/day=``, so its cost grows with
    the number of days, not with the data. Rows without a date are kept.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cutoff = today - timedelta(days=keep_days)
    gone = []
    for year in _folders(fs, root):
        for month in _folders(fs, year) if _value(year) else []:
            for day in _folders(fs, month) if _value(month) else []:
                if _value(day) and date(_value(year), _value(month), _value(day)) < cutoff:
                    fs.delete(day, True)
                    gone.append(day.toString())
    return gone
