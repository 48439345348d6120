"""Helpers the operators share: staged tables, text rules and bounded reads."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logbasin.session import new_folder

SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that workers need not find the package on a path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


# A reader takes up to 4,096 rows of a row group at once, whatever their size, and a writer looks at its own only every hundred.
WIDE_ROWS = {"parquet.block.row.count.limit": 8}


def stage(df: DataFrame, label: str, partition_by: Iterable[str] = (), wide: bool = False) -> DataFrame:
    """Write a table below the shared folder and read it back: the lineage ends there and survives lost executors.

    ``wide`` is for rows of megabytes: row groups of a few of them, so that neither writing nor reading holds many.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.partitionBy(*partition_by).options(**(WIDE_ROWS if wide else {})).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; letters beyond ASCII stay."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that the keys decide, the same on every run."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
