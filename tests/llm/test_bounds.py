"""What keeps memory in proportion on large inputs."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from logbasin.llm import common, exact_topk
from logbasin.session import new_folder


def test_exact_topk_joins_and_broadcasts_nothing(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = exact_topk.top_k(frame, F.col("vec_id") % 10 == 0, 3, block=32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Queries copied to every group would be broadcast, since their size is guessed before they are copied.
    assert "Join" not in plan and "collect_list" not in plan
    whole = np.floor(1024 * x)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
    for q in range(0, 300, 10):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in order]


def test_rows_of_megabytes_get_row_groups_of_a_few(spark, monkeypatch):
    folder = new_folder(spark, "wide")
    monkeypatch.setattr(common, "new_folder", lambda s, label: folder)
    rows = spark.range(60).select("id", F.expr("to_binary(repeat(sha2(cast(id as string), 512), 8192), 'hex')").alias("line")).coalesce(1)
    assert common.stage(rows, "wide", wide=True).agg(F.sum(F.octet_length("line"))).first()[0] == 60 << 19
    (file,) = Path(folder).glob("part-*")
    sizes = [pq.ParquetFile(file).metadata.row_group(i).num_rows for i in range(pq.ParquetFile(file).num_row_groups)]
    assert sum(sizes) == 60 and max(sizes) <= 8
