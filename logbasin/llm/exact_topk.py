"""Exact top-k by inner product with a pivot table.

Components become floor(scale * x); scores are integer inner products. The table holds
the distances of every candidate to ``n_pivots`` pivots. For a query q and a candidate
x the largest |d(q, p) - d(x, p)| over the pivots bounds their distance from below, and
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2 turns that into an upper bound of the score.
Candidates are evaluated in the order of the bound, until the k-th score is above the
next bound; what is left cannot enter the result.

Candidates are dealt into groups, a task each, and every query goes to every group. Both
come to the task as rows, candidates first, so it holds one group and a batch of queries;
nothing is joined or broadcast. Each group gives k rows a query at most, of which the last
step takes the k best.

Defined results: vectors null, empty or holding null or non-finite components take no
part, neither do vectors of another length than the most common; equal scores go by
smaller vec_id; rows that repeat a vec_id are candidates one by one, and none of them
for a query of that id; scores outside the range of long are cut to it; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.llm.common import ship, stage
from logbasin.llm.vectors import usable

ship(__name__)
SCALE, N_PIVOTS, BLOCK, STEP = 1024, 64, 4096, 128
FOUND = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Whole-number components, kept as double: floor(scale * x) of a float is exact there."""
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(x * float(scale)).cast("double")))


def choose_pivots(vectors: DataFrame, n: int = N_PIVOTS) -> np.ndarray:
    """A fixed number of different vectors, by hash order of their ids."""
    drawn = vectors.select("vector", F.xxhash64(F.lit("pivot"), "vec_id").alias("h")).orderBy("h").limit(n).collect()
    return np.unique(np.array([r.vector for r in drawn], dtype=float), axis=0) if drawn else np.zeros((0, 0))


def pivot_distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * m @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles where every sum stays exact, else Python's integers cut to long."""
    if x.size == 0 or np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2**53:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in exact], dtype=np.int64)


def search_block(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, dx: np.ndarray, counter: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query, by elimination. ``counter`` gets the number of evaluated candidates."""
    order = np.argsort(ids, kind="stable")
    ids, x, dx = ids[order], x[order], dx[order]
    dq = pivot_distances(q, pivots)
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    out_q, out_x, out_s = [], [], []
    for i in range(len(qid)):
        low = np.abs(dx - dq[i]).max(axis=1)
        # Distances are rounded; the slack keeps the bound above every true score.
        slack = 1 + 1e-7 * (qq[i] + xx)
        bound = (qq[i] + xx - low * low) / 2 + slack
        bound[ids == qid[i]] = -np.inf
        at = np.argsort(-bound, kind="stable")
        best_s, best_x = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j in range(0, len(at), STEP):
            part = at[j : j + STEP]
            if np.isneginf(bound[part[0]]) or len(best_s) == k and best_s[-1] > bound[part[0]]:
                break
            part = part[~np.isneginf(bound[part])]
            if counter is not None:
                counter.append(len(part))
            s = np.concatenate([best_s, _products(x[part], q[i])])
            v = np.concatenate([best_x, ids[part]])
            top = np.lexsort((v, ~s))[:k]  # ~s falls as s rises, without overflow
            best_s, best_x = s[top], v[top]
        out_q.append(np.full(len(best_s), qid[i]))
        out_x.append(best_x)
        out_s.append(best_s)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) if p else empty for p in (out_q, out_x, out_s))


def _table(pivots: np.ndarray):
    """The pivot table: each candidate with its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            m = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            d = pivot_distances(m, pivots)
            offsets = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], ["vec_id", "distances"]
            ).append_column("vector", b.column("vector"))

    return run


def _search(pivots: np.ndarray, k: int):
    """Rows come by group, its candidates before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for b in batches:
            if not len(b):
                continue
            groups, asked, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "asked", "vec_id"))
            firsts = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (asked[1:] != asked[:-1])]))
            for start, end in zip(firsts, [*firsts[1:], len(b)]):
                m = b.column("vector").slice(start, end - start).flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1)
                if groups[start] != current:
                    current, parts = groups[start], []
                if not asked[start]:
                    parts.append((ids[start:end], m))
                elif parts:
                    parts = [tuple(np.concatenate(p) for p in zip(*parts))]
                    (own, joined), dim = parts[0], m.shape[1]
                    found = search_block(ids[start:end], m, own, joined[:, :dim], pivots, k, joined[:, dim:])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return run


def _no_pivots(df: DataFrame) -> DataFrame:
    return df.withColumn("distances", F.array().cast("array<double>"))


def top_k(df: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", scale: int = SCALE, n_pivots: int = N_PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products for every row that ``is_query`` marks."""
    vectors = scaled(usable(df, vector), scale)
    pivots = choose_pivots(vectors, n_pivots)
    tabled = vectors.mapInArrow(_table(pivots), "vec_id long, distances array<double>, vector array<double>") if len(pivots) else _no_pivots(vectors)
    tabled = stage(tabled, "pivot-table")
    groups = max(1, -(-tabled.count() // block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    candidates = tabled.select(own.alias("grp"), F.lit(False).alias("asked"), "vec_id", F.concat("vector", "distances").alias("vector"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    queries = tabled.where(is_query).select(everywhere.alias("grp"), F.lit(True).alias("asked"), "vec_id", "vector")
    # As many partitions as groups: their work is far more than their bytes, by which Spark would put them together.
    dealt = candidates.unionByName(queries).repartition(groups, "grp").sortWithinPartitions("grp", "asked")
    found = dealt.mapInArrow(_search(pivots, k), FOUND)
    return best(found, k, "score")


def best(found: DataFrame, k: int, score: str) -> DataFrame:
    """The k best rows of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score)
