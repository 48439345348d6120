"""Raw and stored data in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logbasin.operators import alerts
from logbasin.schema import json_record_schema, table_schema
from logbasin.session import new_folder
from logbasin.sources.manifest import CommittedTable
from logbasin.streaming.windows import WindowStore


def spread(df: DataFrame, at_least: int = 0) -> DataFrame:
    """Deal out an input over all cores before costly parsing, in ``at_least`` parts.

    An input with at least as many splits is left as it is: it needs no shuffle
    to keep them busy.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, at_least)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line below a prefix, gzip or plain, as ``value``."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def read_landed(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The lines that a stream has landed, with the hour of their arrival; ``where`` over year, month, day and hour."""
    return CommittedTable(spark, path, kind="text").read("value string, year int, month int, day int, hour int", where)


def lines_with_origin(spark: SparkSession, path: str) -> DataFrame:
    """Every line with the file it stands in and the time that file arrived: (value, file, arrived)."""
    meta = F.col("_metadata")
    return read_lines(spark, path).select("value", meta["file_path"].alias("file"), meta["file_modification_time"].alias("arrived"))


def _counted_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's place in its block; a task reads a block's lines one after the other."""
    at, seen = None, 0
    for batch in batches:
        files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        new = np.ones(len(blocks), bool)
        new[1:] = (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])
        firsts = np.flatnonzero(new)
        place = np.arange(len(blocks))
        start = place[firsts][np.cumsum(new) - 1] if len(blocks) else place
        place = place - start
        if len(blocks):
            if at == (batch.column("file")[0].as_py(), int(blocks[0])):
                place[: firsts[1] if len(firsts) > 1 else len(place)] += seen
            at, seen = (batch.column("file")[-1].as_py(), int(blocks[-1])), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and its number in it, from 1: (value, file, line_number).

    Lines are counted per block of a file first, in a scan that parses nothing; a block's first number is the sum of the
    blocks before it. Numbers depend on neither the splits nor the run, and no line is shuffled. If the splits change between
    the two scans, the second one stops with an error instead of a wrong number.
    """
    meta = F.col("_metadata")
    lines = read_lines(spark, path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    folder = new_folder(spark, "line-starts")
    starts.write.parquet(folder)
    # One row a block; the planner broadcasts them while they are few.
    starts = spark.read.schema(starts.schema).parquet(folder)
    placed = lines.mapInArrow(_counted_in_block, "value string, file string, block long, place long")
    known = F.coalesce("start", F.raise_error(F.lit("the splits of the input have changed: read it again")).cast("long"))
    return placed.join(starts, ["file", "block"], "left").select("value", "file", (known + F.col("place") + 1).alias("line_number"))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line below a prefix, all fields as strings, both vocabularies."""
    reader = spark.read.schema(json_record_schema()).option("recursiveFileLookup", True)
    return reader.option("allowSingleQuotes", False).json(path)


def read_requests(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The stored request table. The schema is fixed, so no file is opened to find it.

    Of a table with commits only committed files count; ``where``, over the hours, selects them before any is listed.
    """
    table = CommittedTable(spark, path)
    if table.exists():
        return table.read(table_schema(), where)
    stored = spark.read.schema(table_schema()).parquet(path)
    return stored.where(where) if where else stored


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What a stream has put into quarantine."""
    return CommittedTable(spark, path, ["reject_reason"], "json").read("line string, record_format string, reject_reason string")


def read_alerts(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The alerts of a stream; ``where`` over ``stream_hour``."""
    alert = alerts.alert_records(spark.createDataFrame([], "value string")).schema
    return CommittedTable(spark, path, ["stream_hour"], "json").read(T.StructType([*alert, T.StructField("stream_hour", T.StringType())]), where)


def read_batch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics that a stream took from each batch's alerts."""
    dimensions = ", ".join(f"{d} string" for d in alerts.DIMENSIONS)
    return CommittedTable(spark, path, []).read(f"{dimensions}, metric string, value double, unit string, timestamp timestamp")


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None,
                 bytes_per_batch: int | None = 10 << 30) -> DataFrame:
    """New lines below a prefix as a stream. A backlog is read in several batches; files per batch take precedence."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    elif bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.text(path)


def read_window_metrics(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The metrics of every window that a stream has seen rows of; ``where`` over the window's ``day``."""
    return WindowStore(spark, path).metrics(where)


def stream_from(spark: SparkSession, source: str, value: str = "value", **options: str) -> DataFrame:
    """A stream from any installed source, such as Kafka; its payload becomes ``data`` as text."""
    df = spark.readStream.format(source).options(**options).load()
    return df.selectExpr(f"cast({value} as string) as data")
