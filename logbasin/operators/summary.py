"""Exact counts, distinct counts and quantiles per key, in one read of the input.

Rows are first cut down to one per (key, value) and one per (key, distinct
value), on the map side and then by a shuffle over those pairs. A hot key is
thus spread over all tasks until it has become a histogram: one row per
distinct value. Only that histogram is brought together by key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be taken of parts and then of the parts' results."""

    kind: str
    column: Column

    def of_rows(self) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[self.kind](self.column)

    def of_parts(self, part: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}[self.kind](part)


def total(column: Column) -> Measure:
    return Measure("sum", column)


def lowest(column: Column) -> Measure:
    return Measure("min", column)


def highest(column: Column) -> Measure:
    return Measure("max", column)


def filled(column: Column) -> Measure:
    """Number of rows where the column is not null."""
    return Measure("count", column)


def number_of(condition: Column) -> Measure:
    return Measure("sum", F.when(condition, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def discrete_rank(percent: int, n: Column) -> Column:
    """Position, from 1, of the smallest value with at least ``percent`` of all values at or below it."""
    return F.greatest(F.lit(1).cast("bigint"), _div(n * percent + 99))


def nearest_rank(percent: int, n: Column) -> Column:
    """Position, from 1, of ``sorted[int(percent / 100 * n)]``; the last value if that is past the end."""
    return F.least(_div(n * percent) + 1, n)


def _div(hundreds: Column) -> Column:
    return ((hundreds - hundreds % 100) / 100).cast("bigint")


def summarize(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: Mapping[str, int],
    measures: Mapping[str, Measure] | None = None,
    distinct: Mapping[str, str] | None = None,
    rank=discrete_rank,
) -> DataFrame:
    """One row per key: ``rows``, the measures, the distinct counts and the quantiles of ``value``.

    Nulls in ``value`` are left out of the quantiles, nulls in a distinct column
    out of its count, as in SQL.
    """
    measures, distinct = dict(measures or {}), dict(distinct or {})
    sets = [f"_d{i}" for i in range(len(distinct))]
    rows = df.select(
        *keys,
        *[F.col(c).alias(s) for s, c in zip(sets, distinct.values())],
        F.col(value).alias("_v"),
        *[m.column.alias(f"_in_{n}") for n, m in measures.items()],
    )
    inputs = {n: F.col(f"_in_{n}") for n in measures}
    if sets:
        # Every row once with its value and once with each distinct column. Only the first carries the measures: a
        # distinct row is its key, one value and nulls.
        width = len(sets)
        has_value = 2**width - 1
        is_value = F.col("_gid") == has_value
        carried = [Measure(m.kind, F.when(F.grouping_id() == has_value, inputs[n])).of_rows().alias(n) for n, m in measures.items()]
        number = F.count(F.when(F.grouping_id() == has_value, 1)).alias("_n")
        pairs = rows.groupingSets([[*keys, "_v"], *[[*keys, s] for s in sets]], *keys, "_v", *sets).agg(
            number, *carried, F.grouping_id().alias("_gid")
        )
        seen = [
            F.sum(
                F.when((F.col("_gid") == 2 ** (width + 1) - 1 - 2 ** (width - 1 - i)) & F.col(s).isNotNull(), 1)
                .otherwise(0)
                .cast("bigint")
            ).alias(s)
            for i, s in enumerate(sets)
        ]
        merged = [m.of_parts(F.when(is_value, F.col(n))).alias(n) for n, m in measures.items()]
        histogram = pairs.groupBy(*keys, is_value.alias("_is_value"), "_v").agg(
            F.sum(F.when(is_value, F.col("_n"))).alias("_n"), *merged, *seen
        )
    else:
        parts = [Measure(m.kind, inputs[n]).of_rows().alias(n) for n, m in measures.items()]
        histogram = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"), *parts)
    return ranked(histogram, keys, quantiles, measures, dict(zip(distinct, sets)), rank)


def ranked(histogram: DataFrame, keys: list[str], quantiles: Mapping[str, int], measures: Mapping[str, Measure] | None = None,
           distinct: Mapping[str, str] | None = None, rank=discrete_rank) -> DataFrame:
    """The summary of a histogram: (keys, ``_v``, ``_n``, a column for each measure and distinct count), one row for each value."""
    counted = F.when(F.col("_v").isNotNull(), F.col("_n"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.withColumn("_upto", F.sum(counted).over(upto)).withColumn("_all", F.sum(counted).over(by_key))
    return placed.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        *[m.of_parts(F.col(n)).alias(n) for n, m in (measures or {}).items()],
        *[F.sum(s).alias(n) for n, s in (distinct or {}).items()],
        *[F.min(F.when(F.col("_upto") >= rank(p, F.col("_all")), F.col("_v"))).alias(n) for n, p in quantiles.items()],
    )
