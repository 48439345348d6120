"""Resampling documents by importance towards a target: hashed n-gram features, log ratios, Gumbel top-k.

Arrow kernels do the text work inside tasks: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``; shifted dictionary indices form the word pairs, which are encoded again, so that CRC runs
once for each distinct word and pair of a slice; ``take`` gives each feature its bucket. A document's buckets are
staged as two bytes each; counts and weights read them back, so a text is split once. Bucket counts are summed in
each task and then by Spark; the table of gains has one row a bucket and is the only thing that tasks share.

A document's weight is the mean gain of its features, its score adds noise that its id decides, and the highest
scores are drawn, which is sampling without replacement in proportion to the exponent of the weights.
Ranks come from ranges of scores: rows are dealt out by range, counted, and numbered inside each range.

Words are ``[0-9a-z]`` and all beyond ASCII, after lower-casing A-Z.

Defined results
* Null, empty and wordless texts have no features and weight 0; they are never drawn (``least_words``).
* Every row gives one row; repeated rows count each, and get neighbouring ranks. A row without doc_id has the noise
  of an empty id; among ties it comes last. Ties beyond doc_id go to fewer features.
* An empty target or empty documents: counts of 0, smoothed like all others.
* Extra columns pass through ``draw``, whatever their names.
* Slices of texts end at ``SLICE_BYTES``, so a very long text is a slice of its own, and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.llm.common import ship, stage

ship(__name__)

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all words and pairs of consecutive words, document by document; each document's features and words."""
    n_docs = len(texts)
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), GAP)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    filled = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(filled).dictionary_encode()
    owner = owner.filter(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(owner, minlength=n_docs)
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    single = np.fromiter(map(crc32, names), dtype=np.int64, count=len(names))
    # Every word and the pair that it begins, side by side; the last word of a document begins none.
    out = np.zeros((len(codes), 2), dtype=np.int64)
    held = np.ones((len(codes), 2), dtype=bool)
    if len(codes):
        out[:, 0] = single[codes]
        held[:, 1] = np.append(owner[1:] == owner[:-1], False)
        first = np.flatnonzero(held[:, 1])
        pairs = pa.array(codes[first] * len(names) + codes[first + 1]).dictionary_encode()
        distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
        tails = np.array([b" " + w for w in names] + [None], dtype=object)[:-1]
        left, right = distinct // len(names), distinct % len(names)
        checks = pa.array(np.fromiter(map(crc32, tails[right].tolist(), single[left].tolist()), dtype=np.int64, count=len(distinct)))
        out[first, 1] = checks.take(pairs.indices).to_numpy(zero_copy_only=False)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    return (out[held] % buckets).astype(kind), n_words + np.maximum(n_words - 1, 0), n_words


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary a document, without a copy of the values."""
    offsets = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def staged_features(docs: DataFrame, keep: list[str], buckets: int = BUCKETS, label: str = "features") -> DataFrame:
    """(row, doc: struct of ``keep``, n_words, n_features, cells): a document's buckets as packed integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, end in slices(texts):
                values, n_features, n_words = features(texts.slice(start, end - start), buckets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(start, end - start), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), _binary(values, n_features).cast(pa.binary())],
                    ["doc", "n_words", "n_features", "cells"],
                )

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").cast("string").alias("text"))
    schema = f"doc {given.schema['doc'].dataType.simpleString()}, n_words long, n_features long, cells binary"
    return stage(given.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), label)


def _cells(column: pa.Array, buckets: int) -> np.ndarray:
    """The buckets of all rows of a batch, one after the other."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind) if data and len(column) else np.zeros(0, kind)


def bucket_counts(staged: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features fell into each bucket; every task sums its own first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column(0), buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return staged.select("cells").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the log ratio of its smoothed shares in target and source, floored."""
    all_s, all_t = (float(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) for counts in (source, target))
    rows = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    rows = rows.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    smooth = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("double") + 1.0
    ratio = smooth("t") * (F.lit(all_s) + float(buckets)) / (smooth("s") * (F.lit(all_t) + float(buckets)))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(staged: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``weight``, the floored mean gain of a document's features; without features 0. Drops ``cells``."""
    table = np.zeros(buckets, dtype=np.int64)
    for r in gains.collect():  # one row a bucket
        table[r["bucket"]] = r["gain"]
    kept = [c for c in staged.columns if c != "cells"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n_features").to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(table[_cells(batch.column("cells"), buckets)])])
            ends = np.cumsum(counts)
            sums = upto[ends] - upto[ends - counts]
            weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(weight, pa.int64())], [*kept, "weight"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in staged.schema if f.name != "cells")
    return staged.select(*kept, "cells").mapInArrow(work, f"{kinds}, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, floored, that the id and the seed decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list[Column], tie: str, label: str = "ranked") -> DataFrame:
    """Adds ``place``: 1, 2, ... over the whole table in that order, without bringing it into one task.

    Rows are dealt out by range, so that range i stands before range i + 1; each is numbered by itself and shifted by
    what earlier ranges hold. ``tie``, unique, splits rows that the order can't tell apart.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(width, *order, F.col(tie)).withColumn("_range", F.spark_partition_id()), label)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as there are ranges.
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order, tie)
    return dealt.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.row_number().over(inside)).drop("_range", "_start")


def scored(docs: DataFrame, target: DataFrame, keep: list[str], percent: int = PERCENT, least_words: int = LEAST_WORDS,
           seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every document as (doc: struct of ``keep``, which holds doc_id, n_words, n_features, weight, score, rank)."""
    source = staged_features(docs, keep, buckets)
    aim = staged_features(target.select("text"), ["text"], buckets, "target-features")
    counts = [stage(bucket_counts(f, buckets), "bucket-counts") for f in (source, aim)]
    weights = weighed(source, bucket_gains(*counts, buckets), buckets)
    rows = stage(weights.withColumn("score", F.col("weight") + noise(F.col("doc.doc_id"), seed)), "weights")
    open_to = rows.where(F.col("n_words") >= least_words)
    drawn = open_to.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc.doc_id").asc_nulls_last(), F.col("n_features").asc()]
    ranked = numbered(open_to, order, "row").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place").cast("long"))).drop("place")
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("row")


def report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    return scored(docs, target, ["doc_id"], **options).select("doc.doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, as they are."""
    found = scored(docs, target, docs.columns, **options).where("rank is not null")
    return found.select(*[F.col(f"doc.`{c}`") for c in docs.columns])
