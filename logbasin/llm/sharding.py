"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``n_slots`` virtual slots, a number that never changes, by
their text's size and checksum, so equal texts share a slot and a shard. A group of
equal texts above 1 / ``PARTS`` of all bytes, or of more rows than four slots hold on
average, is dealt out over as many slots as it needs, repeated rows too. Bytes
are summed for each slot, and a map from slot to shard is stored with a version; a
rebalance writes the next version and moves few slots. The map has ``n_slots`` rows,
so it is planned on the driver and broadcast whatever the size of the data.

Law: ``bytes``. Slots go to the lightest shard, heaviest slot first, so shards differ
by less than one slot. A single record heavier than a shard's share sets the only limit.

Defined results: a null text counts one byte and has the checksum of the empty text;
rows without doc_id and rows that repeat are records like any other; an empty table
gives an empty result and a map of empty slots; extra columns pass through ``assign``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logbasin.llm.common import stage
from logbasin.session import new_folder

N_SLOTS, N_SHARDS, PARTS, LEAST_ROWS = 16384, 16, 256, 1000
MAP = "version int, virtual_slot int, shard int, bytes long, records long"


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum and a number of its own for every row; the texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("copy"),
    )


def heavy_texts(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(size, text_crc32, parts) of the groups to deal out: fewer than ``PARTS`` by bytes and ``n_slots`` / 4 by rows."""
    groups = stage(rows.groupBy("size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "shard-texts")
    n_bytes, n_rows = groups.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    by_bytes = F.ceil(F.col("size") * F.col("n") * PARTS / (n_bytes or 1))
    by_rows = F.ceil(F.col("n") / max(LEAST_ROWS, 4 * (n_rows or 0) / n_slots))
    return groups.select("size", "text_crc32", F.least("n", F.greatest(by_bytes, by_rows)).alias("parts")).where("parts > 1")


def with_slot(rows: DataFrame, heavy: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds ``virtual_slot`` to staged ``records``; ``heavy`` has a proven bound and is broadcast."""
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "copy"), F.col("parts")), F.lit(0))
    slot = F.pmod(F.xxhash64("size", "text_crc32", part), F.lit(n_slots)).cast("int")
    return rows.join(F.broadcast(heavy), ["size", "text_crc32"], "left").withColumn("virtual_slot", slot).drop("parts", "copy")


def slot_loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


class SlotMap:
    """Versions of the map as folders ``version=N`` below one root."""

    def __init__(self, spark: SparkSession, root: str | None = None, n_slots: int = N_SLOTS):
        self.spark, self.n_slots, self.version = spark, n_slots, -1
        self.root = root or new_folder(spark, "slot-map")

    def read(self, version: int | None = None) -> DataFrame:
        n = self.version if version is None else version
        return self.spark.read.schema(MAP).parquet(f"{self.root}/version-{n}")

    def build(self, loads: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
        """Version 0: heaviest slot first, each to the shard that holds the fewest bytes."""
        load = self._loads(loads)
        heap = [(0, s) for s in range(n_shards)]
        owner = {}
        for slot in sorted(load, key=lambda s: (-load[s][0], s)):
            held, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (held + load[slot][0], shard))
        return self._store(owner, load)

    def rebalance(self, loads: DataFrame, n_shards: int) -> DataFrame:
        """The next version for new loads or another number of shards; only slots that must move do.

        Each step moves the slot that fits best from the heaviest shard to the lightest, until no move helps.
        """
        load = self._loads(loads)
        owner = {r.virtual_slot: r.shard for r in self.read().select("virtual_slot", "shard").collect()}
        held = [0] * n_shards
        slots: list[set[int]] = [set() for _ in range(n_shards)]
        homeless = []
        for slot, shard in owner.items():
            if shard < n_shards:
                held[shard] += load[slot][0]
                slots[shard].add(slot)
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda s: (-load[s][0], s)):
            to = min(range(n_shards), key=lambda s: (held[s], s))
            owner[slot] = to
            held[to] += load[slot][0]
            slots[to].add(slot)
        while True:
            top, low = max(range(n_shards), key=lambda s: (held[s], -s)), min(range(n_shards), key=lambda s: (held[s], s))
            gap = held[top] - held[low]
            best = min((s for s in slots[top] if 0 < load[s][0] < gap), key=lambda s: (abs(gap / 2 - load[s][0]), s), default=None)
            if best is None:
                return self._store(owner, load)
            owner[best] = low
            for shard, sign in ((top, -1), (low, 1)):
                held[shard] += sign * load[best][0]
            slots[top].remove(best)
            slots[low].add(best)

    def _loads(self, loads: DataFrame) -> dict[int, tuple[int, int]]:
        """At most ``n_slots`` rows come to the driver, however many records there are."""
        found = {r.virtual_slot: (r.bytes, r.records) for r in loads.collect()}
        return {s: found.get(s, (0, 0)) for s in range(self.n_slots)}

    def _store(self, owner: dict[int, int], load: dict[int, tuple[int, int]]) -> DataFrame:
        self.version += 1
        rows = [(self.version, s, owner[s], *load[s]) for s in range(self.n_slots)]
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{self.root}/version-{self.version}")
        return self.read()


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard``; the map has a fixed number of rows and is broadcast."""
    return rows.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")


def number_rows(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, a row's place in its shard, gapless from 0.

    Places are counted inside a virtual slot and shifted by what the shard's earlier slots hold, so no task sees a
    whole shard.
    """
    before = F.sum("records").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1).join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", (F.col("start") + F.col("_place")).cast("long")).drop("start", "_place")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot of every row, by a fresh map."""
    rows = stage(records(docs), "shard-records")
    rows = stage(with_slot(rows, stage(heavy_texts(rows, n_slots), "shard-heavy"), n_slots), "shard-slots")
    slot_map = SlotMap(docs.sparkSession, n_slots=n_slots).build(slot_loads(rows), n_shards)
    return number_rows(rows, slot_map)
