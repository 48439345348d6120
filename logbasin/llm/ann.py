"""Approximate nearest neighbours over balanced posting lists.

``fit`` draws a bounded sample and halves it again and again along its widest
direction, at the median, so that all clusters hold as many sample vectors; their means
are the centroids. A neighbour graph over the centroids is searched best-first in
memory by every task (its size is bound by ``max_lists``). A vector goes to its nearest
list and, near a boundary, to up to ``replicas`` lists: those within ``closure`` times
the smallest distance and not nearer to a list already taken than to the vector. A
query reads all lists within ``ratio`` times its smallest centroid distance, however
many, and at least ``least_lists``; where the graph's beam doesn't reach beyond them, the
distances to all centroids are computed.

Every row is indexed. A list is stored in blocks of about ``block`` vectors, whatever
its length, and queries are joined with lists block by block, so a list that holds a
third of all vectors is spread over tasks. Found scores are computed in double
precision on the original vectors.

Defined results: vectors null, zero, empty or holding null or non-finite components
take no part, neither do vectors of another length than the most common; ties go to
the smaller vec_id; rows that repeat a vec_id count as one candidate if equal, and are
none for a query of that id; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbasin.llm.common import ship, stage
from logbasin.llm.exact_topk import best
from logbasin.llm.vectors import grouped_blocks, unpack, usable

ship(__name__)
SAMPLE, MAX_LISTS, LIST_ROWS, NEIGHBOURS, BEAM = 20_000, 8192, 256, 16, 96
ROUNDING, PAIRS = 1e-9, 1 << 16
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Centroids:
    """Means of the balanced clusters (unit length) and the graph over them."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def nearest(self, m: np.ndarray, n: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the n nearest centroids for each row, by best-first search of the graph."""
        size, beam = len(self.points), min(max(beam, n), len(self.points))
        out_i, out_d = [], []
        for part in np.array_split(m, max(1, -(-len(m) // 512))):
            rows = np.arange(len(part))[:, None]
            seen = np.zeros((len(part), size), bool)
            seen[:, self.entries] = True
            ids = np.broadcast_to(self.entries, (len(part), len(self.entries))).copy()
            dist = self._distance(part, ids)
            done = np.zeros(ids.shape, bool)
            while True:
                waiting = np.where(done, np.inf, dist)
                at = waiting.argmin(1)
                live = np.flatnonzero(np.isfinite(waiting[np.arange(len(part)), at]))
                if not len(live):
                    break
                done[live, at[live]] = True
                near = self.graph[ids[live, at[live]]]
                new = ~seen[live[:, None], near]
                seen[live[:, None], near] = True
                d = np.full((len(part), near.shape[1]), np.inf)
                d[live] = np.where(new, self._distance(part[live], near), np.inf)
                more = np.zeros((len(part), near.shape[1]), ids.dtype)
                more[live] = near
                ids, dist = np.hstack([ids, more]), np.hstack([dist, d])
                done = np.hstack([done, ~np.isfinite(d)])
                if ids.shape[1] > beam:
                    keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                    ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
            order = np.argsort(dist, axis=1, kind="stable")[:, : min(n, ids.shape[1])]
            out_i.append(ids[rows, order])
            out_d.append(dist[rows, order])
        width = max(a.shape[1] for a in out_i)
        pad = lambda a, v: np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=v)
        return np.vstack([pad(a, 0) for a in out_i]), np.vstack([pad(a, np.inf) for a in out_d])

    def _distance(self, m: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.einsum("bd,bkd->bk", m, self.points[ids]), 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # first to size one, so that no square overflows or vanishes
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit(vectors: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> Centroids | None:
    """Centroids from at most ``sample`` vectors, drawn by hash of their ids; more rows make more lists, up to ``max_lists``."""
    n = vectors.count()
    if not n:
        return None
    drawn = vectors.select("vector", F.xxhash64(F.lit("sample"), "vec_id").alias("h")).orderBy("h").limit(sample).collect()
    m = unit(np.array([r.vector for r in drawn]))
    wanted = int(min(max_lists, max(1, n // list_rows), max(1, len(m) // 8)))
    clusters = [np.arange(len(m))]
    while len(clusters) < wanted:
        halves = []
        for c in clusters:
            part = m[c] - m[c].mean(0)
            axis = np.linalg.svd(part.T @ part)[0][:, 0]
            order = np.argsort(part @ axis, kind="stable")
            halves += [c[order[: len(c) // 2]], c[order[len(c) // 2 :]]]
        clusters = [c for c in halves if len(c)]
    means = np.array([m[c].mean(0) for c in clusters])
    means = means[np.abs(means).max(1) > 1e-9] if np.any(np.abs(means).max(1) > 1e-9) else m[:1]
    points = np.unique(unit(means), axis=0)
    k = min(NEIGHBOURS, len(points))
    graph = np.vstack([np.argsort(-(p @ points.T), axis=1, kind="stable")[:, :k] for p in np.array_split(points, -(-len(points) // 512))])
    # A link to a far point in both directions of the order keeps the graph connected; one that is there already would be found twice.
    ring = (np.arange(len(points)) + 1) % len(points)
    ring = np.where((graph == ring[:, None]).any(1), graph[:, 0], ring)
    graph = np.hstack([graph, ring[:, None]])
    entries = np.unique(np.linspace(0, len(points) - 1, min(32, len(points))).astype(int))
    return Centroids(points, graph, entries)


def closure_lists(c: Centroids, m: np.ndarray, replicas: int, closure: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and lists: the nearest, and boundary copies by distance and by the relative-neighbour rule."""
    ids, dist = c.nearest(m, replicas * 2)
    keep = np.zeros(ids.shape, bool)
    keep[:, 0] = True
    for j in range(1, ids.shape[1]):
        ok = (dist[:, j] <= closure * dist[:, 0] + 1e-12) & (keep.sum(1) < replicas)
        gap = np.linalg.norm(c.points[ids[:, j]][:, None, :] - c.points[ids[:, :j]], axis=2)
        ok &= ~((gap < dist[:, j : j + 1]) & keep[:, :j]).any(1)
        keep[:, j] = ok & np.isfinite(dist[:, j])
    row, col = np.nonzero(keep)
    return row, ids[row, col]


def query_lists(c: Centroids, m: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and lists: all those within ``ratio`` times the smallest distance."""
    beam = max(BEAM, least)
    ids, dist = c.nearest(m, beam, beam)
    inside = lambda d: np.isfinite(d) & (d <= ratio * d.min(1, keepdims=True) + 1e-12)
    keep = inside(dist)
    # Rows whose beam ends within the ratio may have more lists there than the beam holds.
    more = np.flatnonzero(keep.all(1)) if dist.shape[1] < len(c.points) else np.array([], int)
    keep[:, :least] = np.isfinite(dist[:, :least])
    keep[more] = False
    row, col = np.nonzero(keep)
    rows, lists = [row], [ids[row, col]]
    for part in np.array_split(more, -(-len(more) // 512)) if len(more) else []:
        d = np.sqrt(np.maximum(2 - 2 * m[part] @ c.points.T, 0))
        row, col = np.nonzero(inside(d))
        rows.append(part[row])
        lists.append(col)
    return np.concatenate(rows), np.concatenate(lists)


def _dealt(rule):
    """Rows with the lists that ``rule`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            m = unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1))
            row, lists = rule(m)
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *taken.columns], ["list", *taken.schema.names])

    return run


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                qid, q = unpack(b.column("queries"), i)
                ids, x = unpack(b.column("candidates"), i)
                order = np.lexsort((ids,))
                ids, x = ids[order], x[order]
                rough = unit(q) @ unit(x).T
                rough[qid[:, None] == ids[None, :]] = -np.inf
                # The k-th largest with all its ties, so that the smaller ids win, and what rounding may have put below it.
                edge = np.partition(rough, max(0, rough.shape[1] - k), axis=1)[:, max(0, rough.shape[1] - k)]
                row, col = np.nonzero((rough >= edge[:, None] - ROUNDING) & np.isfinite(rough))
                score = cosines(q, x, row, col)
                place = np.lexsort((ids[col], -score, row))
                row, col, score = row[place], col[place], score[place]
                first = np.searchsorted(row, row)
                row, col, score = (a[np.arange(len(row)) - first < k] for a in (row, col, score))
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[col]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def cosines(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Of the pairs (row, col), in one fixed order of addition, so that equal pairs have equal scores in every block."""
    sq, sx = np.abs(q).max(1, keepdims=True), np.abs(x).max(1, keepdims=True)
    q, x = q / sq, x / sx
    nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    out = np.empty(len(row))
    for i in range(0, len(row), PAIRS):
        r, c = row[i : i + PAIRS], col[i : i + PAIRS]
        out[i : i + PAIRS] = (x[c] * q[r]).sum(1) / (nq[r] * nx[c])
    return out


def index(vectors: DataFrame, c: Centroids, replicas: int = 4, closure: float = 1.15) -> DataFrame:
    """(list, vec_id, vector) for every row and every list it goes to."""
    return vectors.mapInArrow(_dealt(lambda m: closure_lists(c, m, replicas, closure)), "list int, vec_id long, vector array<double>")


def search(df: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", replicas: int = 4, closure: float = 1.15, ratio: float = 1.25, least_lists: int = 8, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by cosine, for every row that ``is_query`` marks."""
    vectors = usable(df, vector, zero_ok=False)
    c = fit(vectors)
    if c is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted = stage(index(vectors, c, replicas, closure), "posting-lists")
    asked = vectors.where(is_query).mapInArrow(_dealt(lambda m: query_lists(c, m, ratio, least_lists)), "list int, vec_id long, vector array<double>")
    asked = stage(asked, "list-queries")
    pairs = grouped_blocks(posted, ["list"], block, "candidates").join(grouped_blocks(asked, ["list"], 512, "queries"), "list")
    found = pairs.select("queries", "candidates").mapInArrow(_scan(k), FOUND)
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, "score")
