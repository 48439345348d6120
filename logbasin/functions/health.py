"""Pool health scores, 0 (worst) to 100. Rates are percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Null, not an error, where there is nothing to take a share of."""
    return F.try_divide(part * F.lit(100.0), whole)


def stream_health(error_rate: Column, slow_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - error_rate - slow_rate / 2)


def pool_health(error_rate: Column, avg_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - error_rate - F.least(avg_ms / 100, F.lit(50.0)))


def origin_health(error_rate: Column, slow_rate: Column, avg_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - error_rate * 2 - slow_rate - F.least(F.lit(50.0), avg_ms / 20))
