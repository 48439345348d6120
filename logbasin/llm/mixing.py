"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s wants every document t / s times: a whole number
of copies, and one more with the probability of the rest. Two documents with open
probabilities meet; mass moves from one to the other, weighted by their sizes so
that the expected number of words stays, until one probability is 0 or 1. The other
document carries the residual on. Pairing runs in groups of some ``fan_in`` units;
what each group carries meets in groups of the next level, a reduction tree over the
executors. At the root of a source the open units are drawn, largest first, and each
draw's surplus or lack moves on to the next, so the source misses its target by about
the size of its smallest open document.

Only DataFrame functions are used. Draws are hashes of the seed and the units, so a
rerun takes the same copies.

Defined results: sources go by code point, null last; a null text has no words and
is never taken; rows that agree in doc_id, source and size are drawn as one unit and
get the same copies (ties); an empty table, or one without words, takes nothing;
extra columns pass through ``mix``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.llm.common import fresh_name, stage, uniform, word_count

WEIGHTS, SHARE, MOST, FAN_IN, SEED = (3, 1, 2), 1.5, 2.0, 128, 7


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Targets are min(most * size, level * weight) for the level at which they sum to the share. Sources are sorted by
    cap over weight; the level that holds for the uncapped rest is found with running sums. One task sees a row for
    each source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "wanted": F.sum("source_size").over(everything) * share,
        "capped_before": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("wanted") - F.col("capped_before")) / F.col("weight_left")
    holds = F.col("cap") / F.col("weight") >= level
    s = s.withColumn("level", F.min(F.when(holds, F.struct((F.col("cap") / F.col("weight")).alias("r"), level.alias("v")))).over(everything)["v"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def _pair(state: Column, unit: Column, seed: int, level: int) -> Column:
    """One step of the pivotal method: the carried unit meets the next."""
    a, b = state["open"], unit
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    draw = uniform(F.lit(seed), F.lit(level), a["unit"], b["unit"])
    rise = draw * (up + down) < down
    a_up, b_down = (1 - a["p"]) * a["size"], b["p"] * b["size"]
    a_down, b_up = a["p"] * a["size"], (1 - b["p"]) * b["size"]
    fixed = lambda x, v: F.struct(x["unit"].alias("unit"), F.lit(v).alias("extra"))
    left = lambda x, p: F.struct(x["unit"].alias("unit"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def step(done, kept):
        return F.struct(kept.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))

    return (
        F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done")))
        .when(rise & (a_up <= b_down), step(fixed(a, 1), left(b, b["p"] - a_up / b["size"])))
        .when(rise, step(fixed(b, 0), left(a, a["p"] + b_down / a["size"])))
        .when(a_down <= b_up, step(fixed(a, 0), left(b, b["p"] + a_down / b["size"])))
        .otherwise(step(fixed(b, 1), left(a, a["p"] - b_up / a["size"])))
    )


UNIT = "struct<unit:bigint,size:double,p:double>"
DONE = "array<struct<unit:bigint,extra:int>>"


def _root(state: Column, unit: Column, seed: int) -> Column:
    """The root of a source, largest unit first: what a draw takes too much or too little moves to the next unit."""
    owed, s = state["owed"], unit["size"]
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit["p"] + owed / s))
    extra = (uniform(F.lit(seed), F.lit(-1), unit["unit"]) < p).cast("int")
    return F.struct(
        (owed + (unit["p"] - extra) * s).alias("owed"),
        F.concat(state["done"], F.array(F.struct(unit["unit"].alias("unit"), extra.alias("extra")))).alias("done"),
    )


def round_units(units: DataFrame, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """(source_no, unit, extra 0 or 1) from (source_no, unit, size > 0, p in (0, 1)), units unique in a source.

    Every level groups units by a hash into about ``fan_in`` a group and folds each group; a group's size follows the
    fan-in and not the source. A source of one group is decided at its root, together with one group of the first
    level that was held back: its many small units take up what the draws of larger ones leave over.
    """
    results, level, reserve = [], 0, None
    left = stage(units, "mix-units")
    empty = F.array().cast(DONE).alias("done")
    while True:
        counts = left.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"))
        groups = stage(counts.select("source_no", F.ceil(F.col("n") / fan_in).alias("groups")), "mix-groups")
        dealt = left.join(groups, "source_no").withColumn(
            "cell", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "unit"), F.col("groups"))
        )
        at_root = dealt.where("groups = 1").select("source_no", "unit", "size", "p")
        if reserve is None:
            reserve = dealt.where("groups > 1 and cell = 0").select("source_no", "unit", "size", "p")
            dealt = dealt.where("cell > 0")
        else:
            at_root = at_root.unionByName(reserve.join(groups.where("groups = 1"), "source_no", "left_semi"))
        gathered = at_root.groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct("size", "unit", "p")), asc=False).alias("units"))
        start = F.struct(F.lit(0.0).alias("owed"), empty)
        decided = gathered.select("source_no", F.aggregate("units", start, lambda s, u: _root(s, u, seed))["done"].alias("done"))
        results.append(decided.select("source_no", F.inline("done")))
        if not groups.where("groups > 1").limit(1).count():
            break
        gathered = dealt.where("groups > 1").groupBy("source_no", "cell").agg(F.sort_array(F.collect_list(F.struct("unit", "size", "p"))).alias("units"))
        start = F.struct(F.lit(None).cast(UNIT).alias("open"), empty)
        folded = gathered.select("source_no", F.aggregate("units", start, lambda s, u: _pair(s, u, seed, level)).alias("r"))
        folded = stage(folded.select("source_no", "r.open", "r.done"), "mix-level")
        results.append(folded.select("source_no", F.inline("done")))
        left = folded.where("open is not null").select("source_no", "open.unit", "open.size", "open.p")
        level += 1
    return reduce(DataFrame.unionByName, results)


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """One row for each (doc_id, source, size): how many rows share it, its source's size and target, its copies."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = stage(units.withColumn("unit", F.xxhash64("doc_id", "source", "size")), "mix-documents")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    numbered = targets.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    targets = stage(numbered.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-targets")
    wanted = units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    wanted = wanted.withColumns({"whole": whole, "p": F.col("rate") - whole})
    open_units = wanted.where((F.col("p") > 0) & (F.col("size") > 0))
    extra = round_units(open_units.select("source_no", "unit", (F.col("size") * F.col("rows")).cast("double").alias("size"), "p"), fan_in, seed)
    planned = wanted.join(extra, ["source_no", "unit"], "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("int")
    return planned.select("doc_id", "source", "size", "rows", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row as often as its copies say, with the columns of the input."""
    plan = plan_copies(docs, **options)
    names = {c: fresh_name(docs, f"plan_{c}") for c in ("doc_id", "source", "size", "copies")}
    plan = plan.where("copies > 0").select(*[F.col(c).alias(n) for c, n in names.items()])
    size = fresh_name(docs, "word_size")
    same = [
        F.col("doc_id").eqNullSafe(F.col(names["doc_id"])), F.col("source").eqNullSafe(F.col(names["source"])),
        F.col(size) == F.col(names["size"]),
    ]
    met = docs.withColumn(size, word_count(F.col("text"))).join(plan.hint("shuffle_hash"), same)
    times = fresh_name(met, "copy")
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*[F.col(f"`{c}`") for c in docs.columns])
