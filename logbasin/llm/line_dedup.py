"""Line dedup over levelled sorted runs of line hashes.

A run holds one row for each line key: its 128-bit hash, in how many documents it
was seen and the largest doc_id among them, sorted by hash. ``add`` writes the run
of a batch at level 0; when a level holds ``fanout`` runs they are merged into one
run of the next level, so a store of n batches has O(log n) runs. ``unseen``
merge-anti-joins a batch with the runs; ``drop_frequent`` joins the lines with the
frequent entries of the compacted run, since document counts need every batch.

Defined results
* null or empty text: one empty line, nothing dropped. Keys shorter than
  ``min_chars`` code points never leave. Work is linear in the lines of a text.
* Repeated rows of a doc_id count as one document and are treated alike. Rows
  without doc_id neither count nor lose lines.
* doc_id keeps its type, whatever orders it (text too).
* A batch must bring doc_ids that earlier batches did not bring; ``add_all`` deals
  a table out by hash of doc_id, which holds that.
* Extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logbasin.llm.common import SPACES, fresh_name, lower_ascii, stage
from logbasin.session import new_folder

MIN_CHARS, MIN_DOCS = 40, 5
RUN = "h1 long, h2 long, n_docs long, last_doc {}"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    """128 bits in two independent halves."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts of one doc_id apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) of the long lines; ``pos`` is a line's place in its text, from 0."""
    # The text's key stands below the generator: above it, every line would carry and hash its whole text.
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", *text_key(F.col("text")))
    keys = rows.select("doc_id", "t1", "t2", F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("pos", "key"))
    long = keys.where(F.char_length("key") >= min_chars).withColumn("h", key_hash(F.col("key")))
    return long.select("doc_id", "t1", "t2", "pos", "h.h1", "h.h2")


class LineRuns:
    """The store. ``levels[i]`` lists the folders of level i, oldest first."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2, id_type: str = "long"):
        self.spark, self.fanout, self.schema = spark, fanout, RUN.format(id_type)
        self.root = root or new_folder(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self._written = 0

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``line_hashes`` as a run of its own and compact where a level is full."""
        run = (
            lines.select("h1", "h2", "doc_id").distinct()
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        )
        self.levels[0].append(self._write(run))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def add_all(self, lines: DataFrame, batches: int = 4) -> None:
        """Deal a staged table with a ``batch`` column out, one batch after the other."""
        for b in range(batches):
            self.add(lines.where(F.col("batch") == b))

    def compact(self) -> None:
        """Merge all levels into one run."""
        folders = [f for level in self.levels for f in level]
        if len(folders) > 1:
            self.levels = [[] for _ in self.levels] + [[self._write(self._merged(folders))]]

    def entries(self) -> DataFrame:
        """One row for each line key in the store."""
        folders = [f for level in self.levels for f in level]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self._read(folders[0]) if len(folders) == 1 else self._merged(folders)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines of a batch that no run holds: the batch anti-joined with each run."""
        for folder in (f for level in self.levels for f in level):
            lines = lines.join(self._read(folder).hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        return self.entries().where(F.col("n_docs") >= min_docs)

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(folder)

    def _merged(self, folders: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, map(self._read, folders))
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _write(self, run: DataFrame) -> str:
        folder = f"{self.root}/run-{self._written}"
        self._written += 1
        run.sortWithinPartitions("h1", "h2").write.parquet(folder)
        return folder


def build_runs(docs: DataFrame, batches: int = 4, min_chars: int = MIN_CHARS, fanout: int = 2) -> tuple[LineRuns, DataFrame]:
    """The store over a whole table, and its staged line hashes. Texts are read once."""
    lines = line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    staged = stage(lines, "line-hashes", ["batch"])
    runs = LineRuns(docs.sparkSession, fanout=fanout, id_type=docs.schema["doc_id"].dataType.simpleString())
    runs.add_all(staged, batches)
    runs.compact()
    return runs, staged


def drop_frequent(docs: DataFrame, runs: LineRuns, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents without the lines that ``min_docs`` documents hold, except where the largest doc_id keeps them.

    Adds ``n_lines`` and ``n_dropped`` and replaces ``text``; a text that loses nothing stays as it is (also null).
    The runs hold a line's keeper, so the lines to drop are those that meet a frequent entry of another keeper; they
    are few beside all lines. Their places come to their text by doc_id and text, and texts are shuffled once for it.
    """
    frequent = stage(runs.frequent(min_docs), "line-frequent")
    names = {c: fresh_name(docs, c) for c in ("doc_key", "t1", "t2", "gone", "lines")}
    drops = (
        lines.join(frequent, ["h1", "h2"]).where(F.col("doc_id") != F.col("last_doc"))
        .groupBy(F.col("doc_id").alias(names["doc_key"]), F.col("t1").alias(names["t1"]), F.col("t2").alias(names["t2"]))
        .agg(F.collect_set("pos").alias(names["gone"]))
    )
    drops = stage(drops, "line-drops")
    first, second = text_key(F.col("text"))
    same = (F.col("doc_id") == F.col(names["doc_key"])) & (first == F.col(names["t1"])) & (second == F.col(names["t2"]))
    joined = docs.join(drops, same, "left")
    # Behind a generator the lines are a column, split once and not for every line that is read from them.
    parted = joined.select("*", F.inline(F.array(F.struct(split_lines(F.col("text")).alias(names["lines"])))))
    split, gone = F.col(names["lines"]), F.col(names["gone"])
    # array_except of integers goes through a hash set and keeps the order.
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    return parted.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(split).cast("long").alias("n_lines"), F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, batches: int = 4, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    docs = docs.drop(*[c for c in docs.columns if c in ("n_lines", "n_dropped")])
    runs, lines = build_runs(docs, batches, min_chars)
    return drop_frequent(docs, runs, lines, min_docs)
