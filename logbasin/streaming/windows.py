"""Windowed metrics of a stream as parts of exact histograms, merged in levels.

Every micro-batch writes how often each response time occurs in each window of each pool, among its own rows. Parts
add up, so the metrics, P95 by nearest rank included, are those of a batch over all rows, however rows fall into
batches and however late they come. Nothing is kept in a state store and no watermark drops a row.

Parts of ``fanout`` commits at one level are added up into one commit of the next, so a window is read from a
logarithm of files and each part is rewritten a logarithm of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logbasin.operators import alerts
from logbasin.sources.manifest import CommittedTable

FANOUT = 8
SCHEMA = (
    "window_start timestamp_ntz, window_end timestamp_ntz, F5Environment string, Pool string, VirtualServer string, time_ms bigint,"
    " n bigint, _time bigint, _errors bigint, _slow bigint, day date"
)


class WindowStore:
    """Histograms per window and pool below ``path``, by day of the window."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.table, self.fanout = CommittedTable(spark, path, ["day"]), fanout

    @staticmethod
    def _by_day(parts: DataFrame) -> DataFrame:
        return parts.withColumn("day", F.to_date("window_start"))

    def add(self, requests: DataFrame, number: int, time: str, period: str = "5 minutes") -> None:
        """The histogram of a batch of requests. A number that is in already adds nothing."""
        if self.table.append(self._by_day(alerts.window_histogram(requests, time, period)), "parts", number):
            self.merge()

    def merge(self) -> None:
        """Add up levels that are full, from the lowest on."""
        level = 0
        while True:
            files = self.table.live().where(F.col("level") == level).select("path", "number").collect()
            if len({f["number"] for f in files}) < self.fanout:
                if not self.table.live().where(F.col("level") > level).limit(1).count():
                    return
                level += 1
                continue
            paths = [f["path"] for f in files]
            whole = alerts.merged_histogram(self.table.read(SCHEMA, paths=paths))
            number = self.table.last("merge") + 1
            self.table.append(self._by_day(whole), "merge", number, level + 1, removed=paths)
            level += 1

    def parts(self, where: str | None = None) -> DataFrame:
        return self.table.read(SCHEMA, where)

    def metrics(self, where: str | None = None) -> DataFrame:
        """The metrics of every window; ``where``, over ``day``, selects files before they are opened."""
        return alerts.histogram_metrics(self.parts(where))
