"""Vectors as blocks: numpy works on blocks inside tasks, Spark deals them out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbasin.llm.common import ship

ship(__name__)


def usable(df: DataFrame, vector: str = "embedding", zero_ok: bool = True) -> DataFrame:
    """(vec_id, vector) of the rows that take part: no null id, null vector, empty vector, null or non-finite component.

    Where lengths differ, the most common length (the larger of equals) takes part.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("vector") > 0)
    )
    if not zero_ok:
        good = good.where(F.exists("vector", lambda x: x != 0))
    lengths = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return good.where(F.size("vector") == (lengths[0].dim if lengths else 0))


def grouped_blocks(df: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    """One row for each block of about ``rows`` vectors of a key, as an array of (vec_id, vector).

    A key with many rows gets many blocks: rows are dealt to them by a hash of the id, so a block's size does not
    follow the key's.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_blocks"))
    dealt = df.join(counts, keys) if keys else df.crossJoin(counts)
    part = F.pmod(F.xxhash64("vec_id"), F.col("_blocks"))
    return dealt.withColumn("_part", part).groupBy(*keys, "_part").agg(F.collect_list(F.struct("vec_id", "vector")).alias(name)).drop("_part")


def unpack(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of one block."""
    block = column[i].values
    ids = block.field("vec_id").to_numpy(zero_copy_only=False)
    flat = block.field("vector").flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)
