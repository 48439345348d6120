"""Collocations: phrases that occur often beside their parts, counted exactly in counting quotient filters.

* Texts are read once: pieces are cut into words in numpy, and chunks of a few MB are staged as their distinct words
  and word numbers (two or four bytes a word), each chunk of one language, cut where a piece ends.
* Only words seen ``least`` times can be in a candidate; they get dense ids, by language, in a join of the chunks'
  distinct words with the vocabulary. Nothing that grows with the corpus is broadcast or collected.
* For 2, 3, 4 words: every task packs the ids of its n-grams into a key and counts them in filters
  (``quotient.py``), which are shuffled by prefix of the permuted key and merged prefix by prefix; what stays below
  ``least`` goes. Phrases of n words are counted only where both their parts of n - 1 words may be frequent: a Bloom
  bitmap of bounded size says so. It only saves work; whatever passes is counted exactly.
* Scores, containment and ranks are joins and aggregates over the frequent phrases, in exact decimals.

Defined results
* A null text is empty; a null lang is ``und``, as are rows of that lang. Repeated rows count each. Rows need no id.
* A phrase never crosses the end of a piece or a text. Ties: higher count, then the phrase's bytes.
* Extra columns don't matter; empty tables and wordless texts give no rows.
* A very long text is cut into several chunks; a single piece longer than ``CHUNK_BYTES`` is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.llm import quotient
from logbasin.llm.common import ship, stage

ship(__name__)

LEAST, LONGEST, FIRST = 30, 4, 2000
CHUNK_BYTES = 4 << 20
# Entries that a task holds before it sends its filters off. Merging them takes some five times their 24 bytes each for a
# moment; a chunk adds about a million. More of them save little: with two million 1 to 13 % fewer bytes were sent.
HELD_ENTRIES = 1 << 19
BUCKETS, SALTS = 256, 8
BLOOM_BITS_EACH, LEAST_BLOOM_BITS, MOST_BLOOM_BITS = 16, 1 << 16, 1 << 27

WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# -- chunks -----------------------------------------------------------------------------------


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, and where each begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return raw, bounds[:-1] - bounds[0]


def _cuts(kind: np.ndarray, begins: np.ndarray, limit: int) -> list[int]:
    """Ends of chunks of about ``limit`` bytes, only where a piece ends."""
    ends, at = [], 0
    allowed = np.union1d(np.flatnonzero(kind == BREAK), np.append(begins, len(kind)))
    while at < len(kind):
        i = max(int(np.searchsorted(allowed, at + limit, side="right")) - 1, 0)
        if allowed[i] <= at:
            i = int(np.searchsorted(allowed, at, side="right"))
        at = int(allowed[i])
        ends.append(at)
    return ends


def chunk_words(data: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, np.ndarray] | None:
    """The distinct words of a stretch of texts, and its words as their numbers from 1, with a 0 between pieces."""
    word, fresh = kind == WORD, kind == BREAK
    fresh[begins] = True
    before = np.concatenate([[False], word[:-1]])
    before[begins] = False
    after = np.concatenate([word[1:], [False]])
    after[begins[begins > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return None
    piece = np.cumsum(fresh)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = LOWER[data[word]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    place = np.arange(len(codes)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    line = np.zeros(place[-1] + 1, np.uint32)
    line[place] = codes + 1
    return coded.dictionary, line


def _line_type(n_words: int):
    return np.uint16 if n_words < 1 << 16 else np.uint32


def chunks_of(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, lang, words, counts, line) for the whole table, staged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            for i, end in zip(firsts, [*firsts[1:], len(order)]):
                data, begins = _text_bytes(batch.column("text").take(pa.array(order[i:end])))
                begins = np.unique(begins[begins < len(data)])
                kind, start = KIND[data], 0
                for stop in _cuts(kind, begins, limit):
                    inside = begins[(begins >= start) & (begins < stop)] - start
                    found = chunk_words(data[start:stop], kind[start:stop], inside)
                    start = stop
                    if found is None:
                        continue
                    words, line = found
                    counts = np.bincount(line, minlength=len(words) + 1)[1:]
                    whole = [0, len(words)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int64()), pa.array([langs.dictionary[int(code[order[i]])].as_py()]),
                            pa.ListArray.from_arrays(whole, words.cast(pa.string())), pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())),
                            pa.array([line.astype(_line_type(len(words))).tobytes()], pa.binary()),
                        ],
                        ["chunk", "lang", "words", "counts", "line"],
                    )
                    number += 1

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "chunk long, lang string, words array<string>, counts array<long>, line binary"
    return stage(given.mapInArrow(work, schema), "phrase-chunks", wide=True)


# -- ids --------------------------------------------------------------------------------------


def vocabulary(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """(lang, word, f, id) of the words seen at least ``least`` times, staged, and how many they are. Ids run from 1."""
    seen = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    often = stage(seen.where(F.col("f") >= least).withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int")), "phrase-words")
    sizes = often.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row a bucket.
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sizes.select("bucket", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start")), "phrase-starts")
    inside = Window.partitionBy("bucket").orderBy("lang", "word")
    ids = often.join(F.broadcast(starts.drop("n")), "bucket").withColumn("id", F.col("start") + F.row_number().over(inside))
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return stage(ids.select("lang", "word", "f", F.col("id").cast("long").alias("id")), "phrase-vocabulary"), total


def with_ids(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(line, n_words, pos, ids): the chunk, and the ids of those of its words that have one. Staged."""
    salt = F.pmod(F.col("chunk"), F.lit(SALTS))
    entries = chunks.select("chunk", "lang", salt.alias("salt"), F.posexplode("words").alias("pos", "word"))
    known = words.select("lang", "word", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = entries.join(known, ["lang", "word", "salt"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("met"))
    both = chunks.select("chunk", "line", F.size("words").alias("n_words")).join(met, "chunk")
    return stage(both.select("line", "n_words", F.col("met.pos").alias("pos"), F.col("met.id").alias("ids")), "phrase-ids", wide=True)


def id_width(n_ids: int) -> int:
    """Bits of an id, an even number."""
    width = max(2, n_ids.bit_length())
    width += width % 2
    if width > 32:
        raise ValueError("more than 2^32 frequent words")
    return width


# -- counting ---------------------------------------------------------------------------------


def _bloom_bits(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each permuted key."""
    with np.errstate(over="ignore"):
        z = quotient.mixed(left * quotient.STEP ^ right)
    return (z & np.uint64(bits - 1)).astype(np.int64), ((z >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def bloom(phrases: DataFrame, n: int, width: int, n_phrases: int) -> np.ndarray:
    """A bitmap of the phrases of n words: of bounded size, so beyond it only lets more pass."""
    bits = LEAST_BLOOM_BITS
    while bits < min(MOST_BLOOM_BITS, BLOOM_BITS_EACH * n_phrases):
        bits *= 2
    half = n * width // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in range(n)]
            at = np.sort(np.concatenate(_bloom_bits(*quotient.permuted(*quotient.packed_ids(ids, width), half), bits)))
            cell = at >> 5
            firsts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(at) else np.zeros(0, np.int64)
            words = np.bitwise_or.reduceat(np.int64(1) << (at & 31), firsts) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(cell[firsts], pa.int64()), pa.array(words, pa.int64())], ["cell", "bits"])

    ids = phrases.where(F.col("n") == n).select(*[f"i{k}" for k in range(1, n + 1)])
    found = ids.mapInArrow(work, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # bits / 32 rows at most
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[found.column("cell").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bitmap


def _passes(bitmap: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = _bloom_bits(left, right, len(bitmap) * 32)
    held = lambda at: (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
    return (held(a) & held(b)).astype(bool)


def filters_of(keys: Iterator[tuple[np.ndarray, np.ndarray]], half: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """(prefix, filter) of the keys, sent off whenever ``HELD_ENTRIES`` are held, so that memory doesn't grow with the task."""
    held = quotient.Merger(half)

    def sent() -> Iterator[pa.RecordBatch]:
        entries = held.take()
        if entries is not None and len(entries):
            found = [(p, quotient.pack(e, half, prefix)) for p, e in quotient.by_prefix(entries, half, prefix)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["prefix", "filter"])

    for left, right in keys:
        if len(left):
            held.add(quotient.counted(left, right, half))
        if len(held) >= HELD_ENTRIES:
            yield from sent()
    yield from sent()


def count_phrases(coded: DataFrame, n: int, width: int, least: int, bitmap: np.ndarray | None) -> DataFrame:
    """(n, i1 .. i4, a) of the phrases of n words that occur at least ``least`` times, staged."""
    spark = coded.sparkSession
    half = n * width // 2
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefix = quotient.prefix_bits((4 * tasks - 1).bit_length(), half)
    shared = spark.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def keys(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(len(line) - n + 1, 0))
        for k in range(n):
            at = at[line[at + k] > 0]
        if shared is not None and len(at):
            shorter = lambda s: quotient.permuted(*quotient.packed_ids([line[at + s + k] for k in range(n - 1)], width), (n - 1) * width // 2)
            at = at[_passes(shared.value, *shorter(0))]
            at = at[_passes(shared.value, *shorter(1))]
        return quotient.packed_ids([line[at + k] for k in range(n)], width)

    def chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for i in range(len(batch)):
                n_words = batch.column("n_words")[i].as_py()
                ids = np.zeros(n_words + 1, np.uint64)
                ids[batch.column("pos")[i].values.to_numpy(zero_copy_only=False) + 1] = batch.column("ids")[i].values.to_numpy(zero_copy_only=False).astype(np.uint64)
                yield keys(ids[np.frombuffer(batch.column("line")[i].as_buffer(), _line_type(n_words))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filters_of(chunk_keys(batches), half, prefix)

    def frequent(entries: quotient.Entries | None) -> Iterator[pa.RecordBatch]:
        if entries is None:
            return
        often = entries.count >= least
        left, right = quotient.restored(entries.left[often], entries.right[often], half)
        ids = quotient.unpacked_ids(left, right, n, width)
        ids += [np.zeros(len(left), np.uint64)] * (LONGEST - n)
        count = entries.count[often]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(count), n), pa.int32()), *[pa.array(i.astype(np.int64)) for i in ids], pa.array(count, pa.int64())],
            ["n", *[f"i{k}" for k in range(1, LONGEST + 1)], "a"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = quotient.Merger(half), None
        for batch in batches:
            for p, data in zip(batch.column("prefix").to_pylist(), batch.column("filter")):
                if p != current:
                    yield from frequent(held.take())
                    current = p
                held.add(quotient.unpack(data.as_py(), p, half, prefix))
        yield from frequent(held.take())

    filters = coded.mapInArrow(build, "prefix long, filter binary")
    dealt = filters.repartition("prefix").sortWithinPartitions("prefix")
    schema = ", ".join(["n int", *[f"i{k} long" for k in range(1, LONGEST + 1)], "a long"])
    return stage(dealt.mapInArrow(merge, schema), f"phrases-{n}")


def frequent_phrases(coded: DataFrame, n_ids: int, least: int, longest: int) -> DataFrame:
    """(n, i1 .. i4, a) of the frequent phrases of 2 to ``longest`` words."""
    width = id_width(n_ids)
    found = count_phrases(coded, 2, width, least, None)
    every = found
    for n in range(3, longest + 1):
        found = count_phrases(coded, n, width, least, bloom(found, n - 1, width, found.count()))
        every = every.unionByName(found)
    return every


# -- scores -----------------------------------------------------------------------------------

IDS = [f"i{k}" for k in range(1, LONGEST + 1)]


def _part(start: int, length: int) -> list[Column]:
    """The ids of a part of a phrase, filled up with 0."""
    return [F.col(IDS[start + k]) if k < length else F.lit(0).cast("long") for k in range(LONGEST)]


def _parts(n: int, ranges: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(x).cast("int").alias(f"x{j}") for j, x in enumerate(r[2:])], *[c.alias(f"p{k}") for k, c in enumerate(_part(r[0], r[1]))]) for r in ranges])


def _by_length(longest: int, ranges_of) -> Column:
    """An array of parts, by the number of words of a phrase."""
    column = F.when(F.col("n") == 2, _parts(2, ranges_of(2)))
    for n in range(3, longest + 1):
        column = column.when(F.col("n") == n, _parts(n, ranges_of(n)))
    return column


def scored(phrases: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut (ties: the first)."""
    single = words.select(F.col("id").alias("p0"), *[F.lit(0).cast("long").alias(f"p{k}") for k in range(1, LONGEST)], "f")
    counts = single.unionByName(phrases.select(*[F.col(c).alias(f"p{k}") for k, c in enumerate(IDS)], F.col("a").alias("f")))
    # Both sides of every cut: (start, length, cut, side).
    cuts = _by_length(longest, lambda n: [x for k in range(1, n) for x in ((0, k, k, 0), (k, n - k, k, 1))])
    each = phrases.select(*IDS, "a", F.explode(cuts).alias("c")).select(*IDS, "a", F.col("c.x0").alias("cut"), F.col("c.x1").alias("side"), *[f"c.p{k}" for k in range(LONGEST)])
    met = each.join(counts, [f"p{k}" for k in range(LONGEST)])
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("f")))
    both = met.groupBy(*IDS, "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    exact = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = both.withColumn("score", exact.cast("long")).groupBy(*IDS, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return lowest.select(*IDS, "a", "best.l", "best.r", "best.score")


def contained(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The phrases inside a longer one that is nearly as frequent."""
    inner = F.when(F.col("n") == 3, _parts(3, [(s, 2) for s in range(2)]))
    for n in range(4, longest + 1):
        inner = inner.when(F.col("n") == n, _parts(n, [(s, m) for m in range(2, n) for s in range(n - m + 1)]))
    longer = phrases.where("n > 2").select(F.col("a").alias("f"), F.explode(inner).alias("c")).select("f", "c.*")
    most = longer.groupBy(*[f"p{k}" for k in range(LONGEST)]).agg(F.max("f").alias("f"))
    most = most.select(*[F.col(f"p{k}").alias(c) for k, c in enumerate(IDS)], "f")
    enough = F.expr("100 * cast(f as decimal(20,0)) >= 80 * cast(a as decimal(20,0))")
    return phrases.join(most, IDS).where(enough).select(*IDS)


def spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds lang and phrase."""
    each = rows.select(*IDS, F.posexplode(F.array(*IDS)).alias("pos", "id")).where("id > 0").join(words.select("id", "lang", "word"), "id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"])
    return rows.join(each.groupBy(*IDS).agg(F.first("lang").alias("lang"), F.array_join(texts, " ").alias("phrase")), IDS)


def first_of_each(rows: DataFrame, key: str, order: list[Column], limit: int, salts: int = 64) -> DataFrame:
    """Adds rank, and keeps the first ``limit`` of each key: first inside salted parts of it, then among what is left."""
    part = Window.partitionBy(key, "_part").orderBy(*order)
    near = rows.withColumn("_part", F.pmod(F.xxhash64(*IDS), F.lit(salts))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= limit).drop("_part")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` best-scoring phrases of 2 to ``longest`` words."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    chunks = chunks_of(docs)
    words, n_ids = vocabulary(chunks, least)
    phrases = stage(frequent_phrases(with_ids(chunks, words), n_ids, least, longest), "phrases")
    kept = stage(scored(phrases, words, longest).join(contained(phrases, longest), IDS, "left_anti"), "phrases-scored")
    spoken = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = first_of_each(spelled(kept, words), "lang", order, first)
    return best.join(stage(spoken, "phrase-langs"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
