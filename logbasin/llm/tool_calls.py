"""Chat formatting: link tool calls with their results and write canonical JSON.

``link`` hash-joins calls and results by (conversation, call id), finds for each call
how many calls it depends on in sequence (its level), numbers the calls of a
conversation in topological order (level, then turn), validates the arguments against
the tool's schema, by the kind each JSON value has, and serialises one canonical JSON line
a call: keys sorted at every depth, no blanks, values as they were given (numbers digit by
digit, also those of unknown tools).

Calls with one dependency are followed back to the next call that has none or several, by
doubling the distance, so a chain takes as many rounds as the logarithm of its length.
What is left needs a round for each call with several dependencies on the longest path;
each round is a join of the calls that are still open. Calls in a cycle, or behind one,
never get a level and keep null. Places in a conversation are counted in blocks of turns and
shifted by what earlier blocks hold, so no task sees a whole long conversation.

Defined results: a call without result has status ``unanswered``, a result without
call ``orphan`` (its row has no name and level null); an id called twice is
``ambiguous`` in every row, results that repeat an id are linked each; a null id never
links; arguments that are no whole JSON object, or one that repeats a key, have error
``not_an_object``; a null counts as missing and is written; an unknown tool
has ``unknown_tool``; references to ids that don't exist are ``missing_reference``;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logbasin.llm.common import stage

BLOCK = 256
STRING = r'"((?:[^"\\]++|\\.)*+)"'
# From the end of the last number over all that is none, whole strings too, to the next.
NUMBER = r'(?s)\G((?:[^"0-9-]++|"(?:[^"\\]++|\\.)*+")*+)(-?[0-9][0-9.eE+-]*+)'
MARKED_NUMBER = r'(?s)\G([^"]*+(?:"s(?:[^"\\]++|\\.)*+"[^"]*+)*+)"n([^"]*+)"'
VALUES = "map<string,variant>"


def marked(raw: Column) -> Column:
    """The JSON as a variant in which a string (or key) x is "sx" and a number 1.50 is "n1.50", so that no digit is lost; null if the text isn't one whole JSON value."""
    end = F.xxhash64(raw).cast("string")
    whole = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), end, F.lit('"]')))
    text = F.regexp_replace(F.regexp_replace(raw, "(?s)" + STRING, '"s$1"'), NUMBER, '$1"n$2"')
    return F.when(F.try_variant_get(whole, "$[1]", "string") == end, F.try_parse_json(text))


def kinds(values: Column) -> Column:
    """Field to kind (string, integer, number, boolean, object, array, null) of a marked object's values."""

    def kind(v: Column) -> Column:
        schema, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        return (
            F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema.startswith("OBJECT"), "object")
            .when(schema.startswith("ARRAY"), "array").when(text.startswith("s"), "string").when(text.rlike("^n-?[0-9]+$"), "integer").otherwise("number")
        )

    fields = F.transform(F.map_keys(values), lambda k: F.substring(k, 2, 2**31 - 1))
    return F.map_from_arrays(fields, F.transform(F.map_values(values), kind))


def argument_errors(given: Column, schema: Column, known: Column) -> Column:
    """What is wrong with arguments of such kinds, as a sorted list of texts.

    ``schema``: array of (field, kind, required), null for an unknown tool; kinds are string, integer, number, boolean, object, array.
    """
    kind = lambda f: F.coalesce(F.element_at(given, f["field"]), F.lit("null"))
    missing = F.transform(F.filter(schema, lambda f: f["required"] & (kind(f) == "null")), lambda f: F.concat(F.lit("missing:"), f["field"]))
    fits = lambda f: (kind(f) == f["kind"]) | (kind(f) == "null") | ((kind(f) == "integer") & (f["kind"] == "number"))
    wrong = F.transform(F.filter(schema, lambda f: ~fits(f)), lambda f: F.concat(F.lit("type:"), f["field"]))
    names = F.transform(schema, lambda f: f["field"])
    extra = F.transform(F.array_except(F.map_keys(given), names), lambda k: F.concat(F.lit("unknown:"), k))
    return (
        F.when(given.isNull(), F.array(F.lit("not_an_object")))
        .when(~known, F.array(F.lit("unknown_tool")))
        .otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    )


def quoted(text: Column) -> Column:
    """A JSON string."""
    inner = F.to_json(F.struct(text.alias("v")))
    return F.substring(inner, 6, F.char_length(inner) - 6)


def canonical(arguments: Column) -> Column:
    """A marked variant as JSON without marks; variants hold their keys sorted."""
    return F.regexp_replace(F.regexp_replace(F.to_json(arguments), MARKED_NUMBER, "$1$2"), "(?s)" + STRING.replace('"(', '"s(', 1), '"$1"')


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be ordered: 0 without dependencies, else one more than the highest.

    ``calls`` are unique by (conv_id, call_id); ``edges`` are (conv_id, call_id, needs) between calls that exist.
    """
    edges = stage(edges.distinct(), "calls-edges")
    ids = ["conv_id", "call_id"]
    needing = stage(edges.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs")), "calls-needing")
    back = stage(needing.where("n = 1").select(*ids, F.col("needs").alias("anchor"), F.lit(1).cast("long").alias("steps")), "calls-back")
    met = -1
    while True:
        ahead = back.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("steps").alias("_steps"))
        further = back.join(ahead, ["conv_id", "anchor"], "left")
        further = stage(
            further.select(*ids, F.coalesce("_anchor", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_anchor").isNotNull().alias("met")),
            "calls-back",
        )
        # Distances in a chain leave none out: once a round brings no call to its end, the rest is in cycles.
        before, met = met, further.where("met").count()
        back = further.drop("met")
        if met in (0, before):
            break
    ready = calls.select(*ids).join(needing.select(*ids), ids, "left_anti")
    ready = stage(ready.withColumn("level", F.lit(0).cast("long")), "calls-level")
    several = edges.join(needing.where("n > 1").select(*ids), ids)
    via = back.select("conv_id", F.col("call_id").alias("needs"), "anchor", "steps")
    several = several.join(via, ["conv_id", "needs"], "left").select(*ids, F.coalesce("anchor", "needs").alias("needs"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    several = stage(several.withColumn("level", F.lit(None).cast("long")), "calls-several")
    knots = ready
    while not several.isEmpty():
        done = ready.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("_level"))
        several = several.join(done, ["conv_id", "needs"], "left").withColumn("level", F.coalesce("level", F.col("_level") + F.col("steps"))).drop("_level")
        several = stage(several.select(*ids, "needs", "steps", "level"), "calls-several")
        freed = several.groupBy(*ids).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("_open")).where("_open = 0").drop("_open")
        ready = stage(freed, "calls-level")
        if ready.isEmpty():
            break
        knots = knots.unionByName(ready)
        several = stage(several.join(ready.select(*ids), ids, "left_anti").select(*ids, "needs", "steps", "level"), "calls-several")
    ends = knots.select("conv_id", F.col("call_id").alias("anchor"), "level")
    followed = back.join(ends, ["conv_id", "anchor"]).select(*ids, (F.col("level") + F.col("steps")).alias("level"))
    return knots.unionByName(followed).withColumn("level", F.col("level").cast("int"))


def numbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``place``: 0, 1, ... in each conversation by level (null last), turn and call id."""
    rows = rows.withColumn("_level", F.coalesce("level", F.lit(2**31 - 1))).withColumn("_block", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    sizes = rows.groupBy("conv_id", "_level", "_block").agg(F.count(F.lit(1)).alias("_n"))
    sizes = stage(sizes.withColumn("_levels", F.floor(F.col("_level") / block)), "calls-sizes")
    # First over blocks of levels, then inside each: a chain has as many levels as calls.
    upto = Window.partitionBy("conv_id").orderBy("_levels").rowsBetween(Window.unboundedPreceding, -1)
    many = sizes.groupBy("conv_id", "_levels").agg(F.sum("_n").alias("_n"))
    many = many.select(F.col("conv_id").alias("_conv"), F.col("_levels").alias("_ls"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    near = Window.partitionBy("conv_id", "_levels").orderBy("_level", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(near), F.lit(0)))
    starts = starts.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_levels") == F.col("_ls")))
    starts = starts.select("conv_id", "_level", "_block", (F.col("_base") + F.col("_start")).alias("_start"))
    starts = stage(starts, "calls-starts").withColumnRenamed("conv_id", "_conv").withColumnRenamed("_level", "_l").withColumnRenamed("_block", "_b")
    met = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_b")))
    inside = Window.partitionBy("conv_id", "_level", "_block").orderBy(F.col("turn").asc_nulls_first(), "call_id", "name", "result")
    place = F.col("_start") + F.row_number().over(inside) - 1
    return met.withColumn("place", place.cast("long")).drop("_level", "_block", "_conv", "_l", "_b", "_start")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls: (conv_id, turn, call_id, name, arguments JSON, needs array of ids); results: (conv_id, turn, call_id, result).

    schemas: (name, fields array of (field, kind, required)), one row a tool, staged, so that the planner knows their size and broadcasts them while they are few.
    """
    calls, results = stage(calls, "calls"), stage(results, "results")
    tools = stage(schemas, "tools").select(F.col("name").alias("_tool"), "fields")
    c = calls.join(tools, F.col("name") == F.col("_tool"), "left").withColumn("_args", marked(F.col("arguments")))
    c = c.withColumn("_values", F.try_variant_get("_args", "$", VALUES)).withColumn("_kinds", kinds(F.col("_values")))
    problems = argument_errors(F.col("_kinds"), F.col("fields"), F.col("_tool").isNotNull())
    canon = F.when(F.col("_values").isNotNull(), canonical(F.col("_args")))
    c = c.select("conv_id", "turn", "call_id", "name", problems.alias("_problems"), canon.alias("_canon"))
    counts = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_calls"))
    unique = stage(counts, "calls-ids")
    edges = calls.where("call_id is not null").select("conv_id", "call_id", F.explode("needs").alias("needs"))
    known = unique.select("conv_id", F.col("call_id").alias("needs"))
    ordered = stage(levels(unique, edges.join(known, ["conv_id", "needs"])), "calls-levels")
    # A reference to an id that is no call.
    lost = edges.join(known, ["conv_id", "needs"], "left_anti").select("conv_id", "call_id").distinct().withColumn("_lost", F.lit(True))
    r = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "result", F.lit(True).alias("_answered"))
    c = c.join(unique, ["conv_id", "call_id"], "left").join(stage(ordered, "levels"), ["conv_id", "call_id"], "left")
    c = c.join(lost, ["conv_id", "call_id"], "left").withColumn("_called", F.lit(True))
    both = c.join(r, ["conv_id", "call_id"], "full")
    status = (
        F.when(F.col("_called").isNull(), "orphan").when(F.col("_calls") > 1, "ambiguous").when(F.col("_answered").isNull(), "unanswered").otherwise("linked")
    )
    problems = F.concat("_problems", F.when(F.col("_lost"), F.array(F.lit("missing_reference"))).otherwise(F.array().cast("array<string>")))
    rows = both.select(
        "conv_id", F.coalesce("turn", "result_turn").alias("turn"), "call_id", "name", "result", "result_turn", "level", status.alias("status"),
        F.when(F.col("_called"), problems).alias("errors"), "_canon",
    )
    text = lambda c: F.when(c.isNull(), "null").otherwise(quoted(c))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce("_canon", F.lit("null")), F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")),
        F.lit(',"result":'), text(F.col("result")), F.lit("}"),
    )
    return numbered(stage(rows.withColumn("json", line).drop("_canon"), "calls-linked"))


# -- calls derived from conversations ---------------------------------------------------------

TOOLS = [
    ("lookup", [("query", "string", True), ("limit", "integer", True), ("options", "object", False)]),
    ("measure", [("words", "integer", True), ("ratio", "number", False), ("text", "string", False)]),
    ("reply", [("text", "string", True), ("final", "boolean", True), ("parts", "array", False)]),
]


def tools(spark) -> DataFrame:
    return spark.createDataFrame(TOOLS, "name string, fields array<struct<field:string,kind:string,required:boolean>>")


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each assistant turn as a tool call and the user turn behind it as its result.

    The tool goes by turn % 3 and is a fourth, unknown one where turn % 7 = 5; every call holds the whole text. A call needs
    the call before it in the conversation (two turns before), so chains are as long as conversations; where turn % 7 = 6 it
    also names one that doesn't exist. Limits are texts where turn % 7 = 3, ratios always. Repeated rows make repeated calls.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda at: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), at.cast("string"))
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    origin = F.struct(F.struct(F.col("turn").alias("turn"), F.array(F.col("role"), call_id(F.col("turn"))).alias("path")).alias("origin"), words.alias("counted"))
    lookup = lambda limit: F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"), origin.alias("options")))
    made = (
        F.when((F.col("turn") % 3 == 0) & (F.col("turn") % 7 == 3), lookup(F.lit("5")))
        .when(F.col("turn") % 3 == 0, lookup(F.lit(5)))
        .when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.when(words > 20, words).alias("words"), F.lit("n/a").alias("ratio"), F.col("text").alias("text"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"), F.lit(True).alias("final"), F.array(origin).alias("parts"))))
    )
    name = F.when(F.col("turn") % 7 == 5, "other").when(F.col("turn") % 3 == 0, "lookup").when(F.col("turn") % 3 == 1, "measure").otherwise("reply")
    spoken = t.where("role = 'assistant'").select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("_follows", F.lit(True))
    calls = t.where("role = 'assistant'").join(spoken, ["conv_id", "turn"], "left")
    none = F.array().cast("array<string>")
    needs = F.concat(
        F.when(F.col("_follows"), F.array(call_id(F.col("turn") - 2))).otherwise(none),
        F.when(F.col("turn") % 7 == 6, F.array(F.concat(call_id(F.col("turn")), F.lit("_lost")))).otherwise(none),
    )
    calls = calls.select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), made.alias("arguments"), needs.alias("needs"))
    results = t.where("role = 'user' and turn > 0").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("result"))
    return calls, results
