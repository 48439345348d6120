"""Distinct counts and quantiles that can be stored per hour and united for any range.

A sketch has a bounded size, so a dashboard over a year reads one small row for each hour and key, and no request. Errors
are bounded: a distinct count by 1.04 / sqrt(2^``DISTINCT_BITS``) (one standard error), a quantile's rank by about
2.3 / ``QUANTILE_SIZE``^0.9 with 99 % confidence. The exact reports stay what they are (``plans.jobs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbasin.schema import PARTITIONS

DISTINCT_BITS = 14
QUANTILE_SIZE = 800
CLIENT, TIME = "ip_cliente_externo", "tiempo_respuesta_ms"


def hourly(table: DataFrame, keys: list[str], distinct: str = CLIENT, value: str = TIME) -> DataFrame:
    """One row for each hour and key: rows, a sketch of the distinct values of one column and one of another's quantiles."""
    return table.groupBy(*PARTITIONS, *keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.hll_sketch_agg(distinct, F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(QUANTILE_SIZE)).alias("quantile_sketch"),
    )


def united(sketches: DataFrame, keys: list[str], percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Rows, distinct count (nulls left out) and quantiles of each key over all hours given; null quantiles without a value."""
    whole = sketches.groupBy(*keys).agg(
        F.sum("records").alias("records"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.kll_merge_agg_bigint("quantile_sketch").alias("_q"),
    )
    filled = F.kll_sketch_get_n_bigint("_q") > 0
    quantiles = [F.when(filled, F.kll_sketch_get_quantile_bigint(F.when(filled, F.col("_q")), F.lit(p / 100))).alias(f"p{p}") for p in percents]
    return whole.select(*keys, "records", "distinct_values", *quantiles)
