"""From raw lines to typed records.

Every record keeps its line, its format and, if it cannot be used, the reason
why. Accepted and rejected records come out of the same single pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logbasin.functions import cleaning, patterns, payload, timestamps
from logbasin.schema import FIELDS, OTHER_NAMES, REQUIRED_KEYS, json_record_schema

MIN_LENGTH = 50

# Closes the array a line is wrapped in, so that text after the object shows up.
_END = "_end"
_END_ITEM = f',{{"{_END}":"1"}}]'


def json_items(line: Column) -> Column:
    """The line, read as the first item of an array that a closing item ends."""
    item = T.StructType(json_record_schema().fields + [T.StructField(_END, T.StringType())])
    wrapped = F.concat(F.lit("["), line, F.lit(_END_ITEM))
    items = F.from_json(wrapped, T.ArrayType(item), {"allowSingleQuotes": "false"})
    return F.when(F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}")), items)


def only_object(items: Column) -> Column:
    """The struct of strings a line holds, or null unless it is exactly one JSON object."""
    whole = (F.size(items) == 2) & F.get(items, F.lit(1))[_END].isNotNull()
    return F.when(whole, F.get(items, F.lit(0)))


def parsed_json(line: Column) -> Column:
    return only_object(json_items(line))


def evaluated_once(expressions: dict[str, Column]) -> Column:
    """Several costly columns as one generator call.

    The optimizer copies a projected expression into every filter that uses it.
    It cannot do so below a generator, so the work is done once per row.
    """
    return F.explode(F.array(F.struct(*[c.alias(n) for n, c in expressions.items()])))


def pick_line(df: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The first string column whose trimmed value is longer than ``min_length``, trimmed."""
    candidates = [cleaning.strip(F.col(n)) for n, t in df.dtypes if t == "string"]
    return df.withColumn("value", F.coalesce(*[F.when(F.length(c) > min_length, c) for c in candidates]))


def input_shape(df: DataFrame) -> str:
    """``preparsed``, or the name of the column that holds raw lines."""
    if {"timestamp_syslog", "ip_cliente_externo"} <= set(df.columns):
        return "preparsed"
    for name in ("message", "log"):
        if name in df.columns:
            return name
    strings = [n for n, t in df.dtypes if t == "string"]
    if not strings:
        raise ValueError("no column holds log lines")
    return strings[0]


def detect_format(line: Column) -> Column:
    """``json``, ``text`` or ``unknown``."""
    text = cleaning.strip(line)
    return (
        F.when(parsed_json(text).isNotNull(), "json")
        .when(text.rlike(patterns.SYSLOG_PREFIX), "text")
        .otherwise("unknown")
    )


def split_adjacent_objects(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per JSON object where several stand on a line without a break.

    Only a line that is not one valid object is split, because ``}{`` may also
    stand inside a string. If what stands before the first ``}{`` is an object by itself, the line is not; only
    otherwise is the whole line read, since a failed reading is far dearer than one that succeeds.
    """
    line = F.col(column)
    first = F.concat(F.substring_index(line, "}{", 1), F.lit("}"))
    several = F.startswith(line, F.lit("{")) & F.contains(line, F.lit("}{")) & (parsed_json(first).isNotNull() | parsed_json(line).isNull())
    cut = F.split(line, r"\}\{")
    last = F.size(cut) - 1
    whole = F.transform(cut, lambda p, i: F.concat(F.when(i > 0, "{").otherwise(""), p, F.when(i < last, "}").otherwise("")))
    return df.withColumn(column, F.explode(F.when(several, whole).otherwise(F.array(line))))


def decode_payload(df: DataFrame, column: str = "data") -> DataFrame:
    """Base64, gzip if marked so, UTF-8.

    A row that cannot be decoded has a null ``value``, keeps its encoded text and has the ``reject_reason``
    ``undecodable``, so that it can go to quarantine.
    """
    raw = df.withColumn("_bytes", payload.raw_bytes(F.col(column)))
    # The generator keeps filters on the result from decoding once more.
    plain = raw.withColumn(
        "_bytes",
        F.when(payload.is_gzip(F.col("_bytes")), payload.gunzip(F.when(payload.is_gzip(F.col("_bytes")), F.col("_bytes"))))
        .otherwise(F.col("_bytes")),
    )
    decoded = plain.select(*df.columns, evaluated_once({"value": payload.utf8_text(F.col("_bytes"))}).alias("_decoded"))
    decoded = decoded.select(*df.columns, F.col("_decoded.value").alias("value"))
    return decoded.withColumn("reject_reason", F.when(F.col("value").isNull(), "undecodable"))


def unwrap_envelope(df: DataFrame, column: str = "value") -> DataFrame:
    """Take the ``message`` out of JSON envelopes, then one row per non-blank line; an empty envelope stays as it is."""
    text = cleaning.strip(F.col(column))
    message = F.when(F.startswith(text, F.lit("{")), parsed_json(text)["message"])
    pieces = F.split(F.coalesce(message, text), "\n")
    inner = F.filter(F.transform(pieces, cleaning.strip), lambda one: one != "")
    return df.withColumn(column, F.explode(F.when(message.isNotNull() & (F.size(inner) == 0), F.array(text)).otherwise(inner)))


def _missing_key(line: Column, record: Column) -> Column:
    """A required key is absent. A null field is the only case that needs a closer look."""
    any_null = F.lit(False)
    for key in REQUIRED_KEYS:
        any_null = any_null | record[key].isNull()
    keys = F.json_object_keys(line)
    has_all = F.lit(True)
    for key in REQUIRED_KEYS:
        has_all = has_all & F.array_contains(keys, key)
    return F.when(any_null, ~F.coalesce(has_all, F.lit(False))).otherwise(False)


def _in_record(name: str) -> str:
    """Where a JSON record holds a field: under either of its names."""
    return ", ".join(f"record.{n}" for n in (name, OTHER_NAMES.get(name)) if n)


def raw_records(
    lines: DataFrame,
    column: str = "value",
    layout: str = "tolerant",
    unwrap: bool = True,
    min_length: int = MIN_LENGTH,
    unicode_classes: bool = False,
) -> DataFrame:
    """Detect the format of each line and capture its fields, still as strings.

    Adds ``line``, ``record_format``, ``reject_reason`` and the 22 raw fields to
    the other columns of the input.
    """
    chosen = patterns.LAYOUTS[layout]
    kept = [c for c in lines.columns if c != column]
    text = cleaning.strip(F.col(column))
    df = lines.select(*kept, text.alias("line"))
    line = F.col("line")
    items = json_items(line)
    if unwrap:
        df = df.select(*kept, "line", evaluated_once({"items": items}).alias("outer"))
        df = df.select(*kept, "line", only_object(F.col("outer.items")).alias("outer"))
        message = F.col("outer.message")
        inner = F.filter(F.transform(F.split(message, "\n"), cleaning.strip), lambda one: one != "")
        blank = F.coalesce(F.size(inner) == 0, F.lit(False)) & message.isNotNull()
        df = df.select(
            *kept,
            F.when(message.isNull(), F.col("outer")).alias("outer"),
            message.isNotNull().alias("wrapped"),
            blank.alias("blank"),
            F.explode(F.when(message.isNotNull() & ~blank, inner).otherwise(F.array("line"))).alias("line"),
        )
        items = F.when(F.col("wrapped"), items)
    df = df.select(
        "*", evaluated_once({"items": items, "parts": F.when(~F.startswith(line, F.lit("{")), patterns.marked(line, chosen, unicode_classes))}).alias("raw")
    )
    inside = only_object(F.col("raw.items"))
    df = df.select(
        *kept,
        "line",
        (F.col("blank") if unwrap else F.lit(False)).alias("blank"),
        (F.coalesce(F.col("outer"), inside) if unwrap else inside).alias("record"),
        patterns.checked(F.col("raw.parts"), line, chosen).alias("parts"),
    )
    record, parts = F.col("record"), F.col("parts")
    record_format = (
        F.when(record.isNotNull(), "json").when(line.rlike(patterns.SYSLOG_PREFIX), "text").otherwise("unknown")
    )
    reason = (
        F.when(F.col("blank"), "empty_message")
        .when(F.length("line") <= min_length, "too_short")
        .when(record.isNotNull(), F.when(_missing_key(line, record), "missing_keys"))
        .when(parts.isNotNull(), F.lit(None).cast("string"))
        .when(line.rlike(patterns.SYSLOG_PREFIX), "no_pattern_match")
        .otherwise("unknown_format")
    )
    df = df.select(*kept, "line", record_format.alias("record_format"), reason.alias("reject_reason"), "record", "parts")
    order = {name: i for i, name in enumerate(chosen.fields)}
    fields = [f"coalesce({_in_record(n)}, parts[{order[n]}]) as {n}" for n in FIELDS]
    return df.selectExpr(*kept, "line", "record_format", "reject_reason", *fields)


def typed_records(raw: DataFrame, rules: str = "main", base_year: int | None = None) -> DataFrame:
    """Clean and cast the raw fields and add both event times and the date parts."""
    kept = [c for c in raw.columns if c not in FIELDS]
    # Partition filters use the syslog time in four ways; the request time is
    # often not used at all, so it stays a column that can be left out.
    syslog = timestamps.syslog_time(F.col("timestamp_syslog"), base_year, F.col("timestamp_apache"))
    timed = raw.select("*", evaluated_once({"syslog": syslog}).alias("times"))
    time = F.col("times.syslog")
    return timed.select(
        *kept,
        *[cleaning.clean(n, F.col(n), rules).alias(n) for n in FIELDS],
        time.alias("parsed_timestamp_syslog"),
        timestamps.request_time(F.col("timestamp_apache")).alias("parsed_timestamp_apache"),
        *[part.alias(n) for n, part in timestamps.date_parts(time).items()],
    )


def parse_lines(lines: DataFrame, rules: str = "main", base_year: int | None = None, **options) -> DataFrame:
    """Raw lines to typed records, rejected ones included (see ``reject_reason``)."""
    return typed_records(raw_records(lines, **options), rules, base_year)


def accepted(records: DataFrame) -> DataFrame:
    return records.where("reject_reason is null").drop("line", "record_format", "reject_reason")


def rejected(records: DataFrame) -> DataFrame:
    """What goes to quarantine: the line, its format and why it was refused."""
    return records.where("reject_reason is not null").select("line", "record_format", "reject_reason")


def positional_records(lines: DataFrame, column: str = "value", layout: str = "tolerant",
                       names: list[str] | None = None) -> DataFrame:
    """Captured groups under the given names, in order; a name without a group is null.

    Values stay strings; placeholders become null and quotes are dropped.
    """
    chosen = patterns.LAYOUTS[layout]
    names = list(names or chosen.fields)
    kept = [c for c in lines.columns if c != column]
    parts = patterns.captured(cleaning.strip(F.col(column)), chosen)
    df = lines.select(*kept, F.col(column), evaluated_once({"parts": parts}).alias("raw"))
    values = [cleaning.clean_positional(F.get(F.col("raw.parts"), F.lit(i))).alias(n) for i, n in enumerate(names)]
    return df.where("raw.parts is not null").select(*kept, *values)


def canonical_columns(df: DataFrame) -> dict[str, Column]:
    """Each canonical field from whichever vocabulary the input has; both are tried if both are there."""
    found = {}
    for name in FIELDS:
        present = [n for n in (name, OTHER_NAMES.get(name)) if n in df.columns]
        found[name] = F.coalesce(*[F.col(n) for n in present]) if present else F.lit(None).cast("string")
    return found


def preparsed_records(df: DataFrame) -> DataFrame:
    """Records that arrive as columns: numbers cast, date parts from the request time, line rebuilt."""
    raw = canonical_columns(df)
    line = F.concat_ws(
        " ",
        *[raw[n] for n in (
            "timestamp_syslog", "hostname", "ip_cliente_externo", "metodo",
            "recurso", "protocolo", "codigo_respuesta", "tamano_respuesta",
        )],
    )
    typed = [c.try_cast(cleaning.NUMERIC_TYPES.get(n, "string")).alias(n) for n, c in raw.items()]
    extra = [F.col(n) for n in ("processed_at", "log_type") if n in df.columns]
    once = evaluated_once({"request": timestamps.request_time(raw["timestamp_apache"])}).alias("times")
    time = F.col("times.request")
    return df.select("*", once).select(
        line.alias("raw_log"), *typed, *extra, time.alias("parsed_timestamp_apache"),
        *[part.alias(n) for n, part in timestamps.date_parts(time).items()],
    )
