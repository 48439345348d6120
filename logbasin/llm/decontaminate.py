"""Benchmark decontamination: which words of each document stand in a passage of a benchmark, and their removal.

The benchmark's windows (``n`` consecutive words; an item of fewer words is one window) become a hash set: a
bitmap of window hashes of bounded size, held in the plan as a literal, so that every task tests its own windows
inside the row, without a join. Hashes of ``n`` words are built by doubling (1, 2, 4, 8 words), so a position costs
a few hashes, whatever ``n`` is. What passes the bitmap (hits and few others) is verified: an equality join of the
words themselves with the table of windows, broadcast up to ``BROADCAST_WINDOWS`` windows and salted beyond. Texts
are read once; what is shuffled are rows of a few numbers, and the words of passing windows.

Words are ``[0-9a-z]`` and all beyond ASCII, after lower-casing A-Z.

Defined results
* Null, empty and wordless texts have no words and no hits; such items have no windows.
* Overlapping hits count each word once. An item counts once for a document, also if its id is repeated in the
  benchmark; an item without id hits words but is not listed.
* Every row of documents gives one row, rows repeated or without doc_id too.
* Extra columns pass through ``decontaminate``, whatever their names; empty tables give empty or clean results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbasin.llm.common import lower_ascii, stage

N = 10
GAP = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
# The same before lower-casing.
CASED_GAP = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 256, 1 << 12, 1 << 24
BROADCAST_WINDOWS = 200_000
SALTS = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{GAP}]+", -1), "")


def _rest(values: Column, after: int) -> Column:
    return F.slice(values, after + 1, F.greatest(F.size(values) - after, F.lit(0)))


def with_window_hashes(df: DataFrame, lengths: list[int], words: str = "words") -> DataFrame:
    """Adds ``hashes_<n>`` for each length: the hash of the n words from each position on.

    Each power of two is a projection of its own, since it is used more than once.
    """
    df = df.withColumn("_p1", F.transform(words, lambda w: F.xxhash64(w)))
    both = lambda a, b, after: F.zip_with(a, _rest(b, after), lambda x, y: F.xxhash64(x, y))
    power = 1
    while 2 * power <= max(lengths, default=1):
        df = df.withColumn(f"_p{2 * power}", both(F.col(f"_p{power}"), F.col(f"_p{power}"), power))
        power *= 2
    powers = [p for p in (1 << i for i in range(30)) if p <= power]
    for n in lengths:
        parts = [p for p in reversed(powers) if n & p]
        starts = [sum(parts[:i]) for i in range(len(parts))]
        whole = reduce(lambda acc, part: both(acc, F.col(f"_p{part[0]}"), part[1]), zip(parts[1:], starts[1:]), F.col(f"_p{parts[0]}"))
        df = df.withColumn(f"hashes_{n}", F.slice(whole, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))))
    return df.drop(*[f"_p{p}" for p in powers])


def windows_of(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, len, window) of every window of every item; ``window`` is its words, joined by blanks."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at")
    return w.select("item_id", "words", "len", at).select("item_id", "len", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("window"))


class WindowSet:
    """The windows of a benchmark: staged tables and the bitmap of their hashes."""

    def __init__(self, items: DataFrame, n: int = N):
        self.n = n
        of_items = stage(windows_of(items, n), "bench-windows")
        distinct = of_items.select("len", "window").distinct().withColumn("wid", F.monotonically_increasing_id())
        self.windows = stage(distinct, "bench-distinct")
        self.items = stage(of_items.where("item_id is not null").join(self.windows, ["len", "window"]).select("wid", "item_id").distinct(), "bench-items")
        found = self.windows.groupBy("len").count().collect()  # one row for each length, n at most
        self.lengths = sorted(r["len"] for r in found)
        self.size = sum(r["count"] for r in found)
        self.bits = LEAST_BITS
        while self.bits < min(MOST_BITS, BITS_PER_WINDOW * self.size):
            self.bits *= 2
        self.bitmap = self._bitmap()

    def _slot(self, h: Column) -> Column:
        return h.bitwiseAND(F.lit(self.bits - 1))

    def _bitmap(self) -> Column:
        """Bit h mod bits is set for every window's hash: at most MOST_BITS / 64 numbers, however large the benchmark."""
        w = with_window_hashes(self.windows.select(F.split("window", " ").alias("words"), "len"), self.lengths)
        of_length = [F.when(F.col("len") == n, F.get(f"hashes_{n}", F.lit(0))) for n in self.lengths]
        slot = self._slot(F.coalesce(*of_length, F.lit(0)))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        rows = w.select((slot / 64).cast("long").alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
        cells = ["0"] * (self.bits // 64)
        for r in rows:
            cells[r["at"]] = str(r["bits"])
        return F.split(F.lit(",".join(cells)), ",").cast("array<bigint>")

    def may_hold(self, h: Column) -> Column:
        slot = self._slot(h)
        cell = F.get(self.bitmap, F.call_function("shiftright", slot, F.lit(6)).cast("int"))
        return F.getbit(cell, slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _joined(rows: DataFrame, windows: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Equality join with the windows: broadcast if they are few, else salted, since a passage may be in many documents."""
    if few:
        return rows.join(F.broadcast(windows), keys)
    salted = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def scan(docs: DataFrame, windows: WindowSet, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of documents as (row, doc: struct of ``keep``, n_words), and their hits as (row, pos, len, wid)."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), words_of(F.col("text")).alias("words"))
    base = with_window_hashes(base, windows.lengths)

    def passing(n: int) -> Column:
        hashes = F.col(f"hashes_{n}")
        at = F.array_compact(F.transform(hashes, lambda h, i: F.when(windows.may_hold(h), i)))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("window")))

    none = F.array().cast("array<struct<pos:int,len:int,window:string>>")
    passed = F.concat(none, *[passing(n) for n in windows.lengths])
    staged = stage(
        base.select(F.monotonically_increasing_id().alias("row"), "doc", F.size("words").cast("long").alias("n_words"), passed.alias("passed")), "scan"
    )
    one = staged.select("row", F.explode("passed").alias("p")).select("row", "p.pos", "p.len", "p.window")
    hits = _joined(one, windows.windows, ["len", "window"], windows.size <= BROADCAST_WINDOWS)
    return staged.drop("passed"), stage(hits.select("row", "pos", "len", "wid"), "scan-hits")


def hit_words(hits: DataFrame) -> DataFrame:
    """(row, at): every word that a hit covers, once, counted from 0."""
    return hits.select("row", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("at")).distinct()


def report(docs: DataFrame, items: DataFrame, n: int = N, keep: list[str] | None = None) -> DataFrame:
    """Each document's words, words hit, and the items whose windows it holds.

    Returns the columns ``keep`` (doc_id), n_words, n_hit, n_items, item_ids (as sorted texts), items_sha256, contaminated.
    """
    windows = WindowSet(items, n)
    keep = keep or ["doc_id"]
    base, hits = scan(docs, windows, keep)
    counts = hit_words(hits).groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    held = _joined(hits.select("row", "wid").distinct(), windows.items, ["wid"], windows.size <= BROADCAST_WINDOWS)
    held = held.select("row", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = held.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    joined = base.join(counts, "row", "left").join(listed, "row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *[F.col(f"doc.`{c}`") for c in keep], "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, remove: str = "spans") -> DataFrame:
    """Documents without the words that are hit (``spans``), or without the documents that hold any (``documents``).

    A word that is hit goes with the gap behind it; other documents keep their text as it is, null too.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove}")
    base, hits = scan(docs, WindowSet(items, n), docs.columns)
    columns = [F.col(f"doc.`{c}`") for c in docs.columns]
    if remove == "documents":
        return base.join(hits.select("row").distinct(), "row", "left_anti").select(*columns)
    hit = base.join(hits.select("row").distinct(), "row")
    pieces = F.regexp_extract_all("doc.text", F.lit(f"^[{CASED_GAP}]+|[^{CASED_GAP}]+[{CASED_GAP}]*"), F.lit(0))
    # A gap at the start is a piece of its own, before the first word.
    lead = F.col("doc.text").rlike(f"^[{CASED_GAP}]").cast("int")
    each = hit.select("row", lead.alias("lead"), F.posexplode(pieces).alias("pos", "piece")).withColumn("at", F.col("pos") - F.col("lead"))
    kept = each.join(hit_words(hits), ["row", "at"], "left_anti")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"])
    texts = kept.groupBy("row").agg(F.array_join(in_order, "").alias("left"))
    joined = base.join(hits.select("row").distinct().withColumn("is_hit", F.lit(True)), "row", "left").join(texts, "row", "left")
    text = F.when(F.col("is_hit"), F.coalesce("left", F.lit(""))).otherwise(F.col("doc.text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])

