"""MinHash near-duplicates: universal hash minima, banding, verification, components.

1. ``features`` reads every whole text once: the set of its word shingles (64-bit
   hashes), a 128-bit digest of the set and, per band, a hash of ``rows`` minima.
   Documents with one set are a class, represented by the smallest doc_id.
2. Representatives that share a bucket are candidates. Every representative is tested
   against one hub, the member of its buckets with most neighbours: work linear in a
   bucket's size. A pair passes on the signature (minima that agree) and is then
   confirmed on the full sets.
3. Links are joined to components by alternating large-star and small-star.
4. Buckets chain representatives into candidate groups, by the same stars. In a group
   that still holds several components, members outside its largest component are
   compared with all its members, block by block, and each pair that passes the
   signature is confirmed on the full sets. What is in one component is not compared.

With 32 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability
0.672 ** 32 = 3e-6, and falls below the signature's limit with about the same; more
similar pairs by far less. No bucket, group or number of partners is capped.

Defined results: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of
fewer words than a shingle is one shingle of all its words; null, empty or blank texts
have no shingles and link with nothing. Rows that repeat a doc_id are judged by their
own texts. doc_id is a whole number. Rows without it take no part and have no component. Empty tables
give empty results; extra columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbasin.llm.common import fresh_name, ship, stage

ship(__name__)
WORDS, THRESHOLD, BANDS, ROWS, SLICE = 5, 80, 32, 5, 1 << 21
CELL = 8
FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
SETS = "rep long, shingles array<long>, minima array<tinyint>"

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of texts that lie end to end, and where each text's words begin."""
    byte = np.arange(256, dtype=np.uint8)
    byte[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    value = odd_numbers(256, 11)[byte]
    blank = space[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_text] = ~blank[starts_text]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(first) - 1
    at = np.arange(len(data)) - starts[word]
    at[blank] = 0
    power = np.ones(int(at.max()) + 1, np.uint64)
    power[1:] = np.uint64(0x9FB21C651E98DF25)
    power = np.cumprod(power)
    terms = value[data] * power[at]
    terms[blank] = 0
    return mixed(np.add.reduceat(terms, starts)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    h, begin = word_hashes(data, offsets)
    times = odd_numbers(words, 23)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        rolled += h[i : i + len(rolled)] * times[i]
    rolled = mixed(rolled)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            short = (h[a:b] * odd_numbers(b - a, 23)).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mixed(np.array([short], np.uint64))
        else:
            yield h[:0]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima of universal hashes a * x + b modulo 2^32 over the upper halves of the shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = odd_numbers(n, 37).astype(np.uint32)[:, None], (odd_numbers(n, 41) >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for j in range(0, len(x), 1024):
        np.minimum(least, (a * x[None, j : j + 1024] + b).min(axis=1), out=least)
    return least


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    m = minima.astype(np.uint64).reshape(-1, rows)
    return mixed((m * odd_numbers(rows, 53)[None, :]).sum(axis=1, dtype=np.uint64) + odd_numbers(len(m), 59))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column of about SLICE bytes: first and last row, bytes and offsets. A null has no bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _features(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in _texts(b.column("text")):
                n, digest, keys = [], [], []
                for s in shingle_sets(data, offsets, words):
                    n.append(len(s))
                    digest.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                    keys.append(band_keys(signature(s, bands * rows), rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
                d = np.array(digest)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(keys, pa.int64())],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def _sets(words: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in _texts(b.column("text")):
                sets = list(shingle_sets(data, offsets, words))
                low = [signature(s, minima).astype(np.uint8).view(np.int8) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), _lists([s.view(np.int64) for s in sets], pa.int64()), _lists(low, pa.int8())],
                    ["rep", "shingles", "minima"],
                )

    return run


def signature_limit(threshold: int, minima: int) -> int:
    """How many minima must agree: five standard deviations below what similar sets have."""
    p = threshold / 100
    return int(np.floor(minima * p - 5 * np.sqrt(minima * p * (1 - p))))


def similar(a: Column, b: Column, threshold: int) -> Column:
    """The exact test on the full sets."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= threshold * (F.size(a) + F.size(b) - both)


def agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


# -- components ---------------------------------------------------------------------------


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m) with the smallest v of each u, staged: a join with it can be split at a hot u."""
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-minima")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour v of u meets the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.where("v > u").join(_minima(both), "u")
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours meet the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down)
    met = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every u that is not the smallest of its component v, from edges (u, v) with u <> v."""
    edges, last = stage(edges, "cc-edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last or not state[0]:
            return edges
        last = state
        edges = stage(small_star(stage(large_star(edges), "cc-large")), "cc-small")


# -- verification in blocks -----------------------------------------------------------------


def _columns(block: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, minima, shingles end to end and their offsets."""
    ids, labels = (block.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "label"))
    minima = block.field("minima").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    lengths = block.field("shingles").value_lengths().to_numpy(zero_copy_only=False)
    return ids, labels, minima, block.field("shingles").flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lengths])


def block_links(left: pa.StructArray, right: pa.StructArray, threshold: int, limit: int) -> list[tuple[int, int]]:
    """Links between members of two blocks that have different labels; what is found linked is not compared again."""
    ids, label, minima, flat, at = _columns(right)
    size = np.diff(at)
    values, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(values), np.int64)
    lid, llabel, lminima, lflat, lat = _columns(left)
    found = []
    for i in range(len(lid)):
        own = lflat[lat[i] : lat[i + 1]]
        fits = (label != llabel[i]) & (100 * np.minimum(size, len(own)) >= threshold * np.maximum(size, len(own)))
        j = np.flatnonzero(fits)
        j = j[(minima[j] == lminima[i]).sum(axis=1) >= limit]
        if not len(j):
            continue
        own_at = np.searchsorted(values, own)
        hit = own_at < len(values)
        hit[hit] = values[own_at[hit]] == own[hit]
        mark[own_at[hit]] = 1
        both = np.array([mark[flat[at[k] : at[k + 1]]].sum() for k in j])
        mark[own_at[hit]] = 0
        ok = j[100 * both >= threshold * (len(own) + size[j] - both)]
        # One link for each component met is enough.
        _, once = np.unique(label[ok], return_index=True)
        found += [(int(lid[i]), int(ids[k])) for k in ok[once]]
    return found


def _compare(threshold: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                links = block_links(b.column("some")[i].values, b.column("members")[i].values, threshold, limit)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _blocks(rows: DataFrame, name: str, size: str, across: str, block: int, cell: int) -> DataFrame:
    """A group's members in blocks of about ``block``, dealt by hash, for a grid of cells.

    ``size`` and ``across`` name the columns with the number of members on this side and on the other one. A block
    lies in row ``own_cell`` of the grid and is copied to every cell of that row.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col(size) / block)))
    blocks = dealt.groupBy("grp", "part").agg(
        F.collect_list(F.struct("rep", "label", "minima", "shingles")).alias(name), F.ceil(F.first(across) / (block * cell)).alias("cells")
    )
    beside = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    return blocks.select("grp", F.floor(F.col("part") / cell).alias("own_cell"), beside.alias("other_cell"), name)


def _spread(met: DataFrame, sets: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(rep, hub, part) and (hub, part, hub_shingles, hub_minima): at most about ``block`` representatives a part."""
    heavy = stage(met.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")).where("parts > 1"), "mh-heavy")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = met.join(heavy, "hub", "left").select("rep", "hub", F.pmod(F.xxhash64("rep"), parts).alias("part"))
    hubs = sets.join(met.select("hub").distinct(), F.col("rep") == F.col("hub"), "left_semi").withColumnRenamed("rep", "hub")
    copies = hubs.join(heavy, "hub", "left").select(
        "hub", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("shingles").alias("hub_shingles"), F.col("minima").alias("hub_minima"),
    )
    return stage(dealt, "mh-dealt"), copies


# -- the operator -------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = 256, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(texts.mapInArrow(_features(words, bands, rows), FEATURES), "mh-features")
    parted = found.where("n_shingles > 0 and doc_id is not null")
    classes = stage(
        parted.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "mh-classes",
    )
    # Buckets with more than one representative, and the neighbours each has there.
    buckets = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = stage(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "mh-shared")
    occupied = stage(buckets.join(shared, "bucket"), "mh-occupied")
    weight = occupied.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = stage(occupied.join(weight, "rep"), "mh-weighed")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("less"), "n")).alias("hub"))
    hubs = stage(hubs.select("bucket", "hub"), "mh-hubs")
    beside = stage(weighed.join(hubs, "bucket").where(F.col("rep") != -F.col("hub.less")).select("rep", "n", "hub").distinct(), "mh-beside")
    met = beside.groupBy("rep", "n").agg(F.max("hub").alias("hub"))
    met = stage(met.select("rep", "n", (-F.col("hub.less")).alias("hub"), F.col("hub.n").alias("hub_n")), "mh-met")
    # Full sets of the candidates only.
    needed = stage(occupied.select("rep").distinct(), "mh-needed")
    n_minima = bands * rows
    kept = texts.join(needed, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = stage(kept.mapInArrow(_sets(words, n_minima), SETS), "mh-sets")
    limit = signature_limit(threshold, n_minima)
    fits = 100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")
    dealt, hub_sets = _spread(stage(met.where(fits).select("rep", "hub"), "mh-fits"), sets, block)
    pairs = dealt.join(sets, "rep").join(hub_sets, ["hub", "part"])
    linked = pairs.where((agreeing(F.col("minima"), F.col("hub_minima")) >= limit)).where(similar(F.col("shingles"), F.col("hub_shingles"), threshold))
    links = stage(linked.select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), "mh-links")
    first = components(links)
    # Groups that the buckets chain together and that hold several components.
    chains = components(beside.select(F.col("rep").alias("u"), (-F.col("hub.less")).alias("v")))
    named = needed.join(first.select(F.col("u").alias("rep"), F.col("v").alias("label")), "rep", "left")
    named = named.join(chains.select(F.col("u").alias("rep"), F.col("v").alias("grp")), "rep", "left")
    named = stage(named.select("rep", F.coalesce("label", "rep").alias("label"), F.coalesce("grp", "rep").alias("grp")), "mh-named")
    parts = named.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = F.max(F.struct("size", "label"))
    mixed_groups = parts.groupBy("grp").agg(
        F.count(F.lit(1)).alias("labels"), largest["label"].alias("main"), F.sum("size").alias("all_size"), (F.sum("size") - largest["size"]).alias("some_size")
    )
    mixed_groups = stage(mixed_groups.where("labels > 1").drop("labels"), "mh-groups")
    open_rows = stage(named.join(mixed_groups, "grp").join(sets, "rep"), "mh-open")
    some = _blocks(open_rows.where("label <> main"), "some", "some_size", "all_size", block, cell)
    members = _blocks(open_rows, "members", "all_size", "some_size", block, cell)
    members = members.select("grp", F.col("other_cell").alias("own_cell"), F.col("own_cell").alias("other_cell"), "members")
    more = some.join(members, ["grp", "own_cell", "other_cell"]).select("some", "members").mapInArrow(_compare(threshold, limit), "u long, v long")
    final = components(links.unionByName(stage(more.where("u <> v").distinct(), "mh-more")))
    # Back to all rows: by the class of the row's set.
    labelled = classes.join(final.select(F.col("u").alias("rep"), F.col("v").alias("component_id")), "rep", "left")
    labelled = labelled.where("rows > 1 or component_id is not null").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    labelled = stage(labelled, "mh-labels")
    out = found.select("doc_id", "n_shingles", "d1", "d2").join(labelled, ["d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each component the row of the smallest doc_id stays (one, if it repeats)."""
    same = near_duplicates(docs, **options)
    key = fresh_name(docs, "kept_id")
    ids = stage(same.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct(), "mh-kept")
    # doc_id as a plain column after the join: the rows lie together by it, so dropping repeats needs no more shuffle.
    one = docs.where("doc_id is not null").join(ids, F.col("doc_id").cast("long") == F.col(key), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
