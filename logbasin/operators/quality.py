"""Checks on records and tables. Each result is itself a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logbasin.functions import cleaning, patterns
from logbasin.operators.parse import evaluated_once
from logbasin.schema import DERIVED_TYPES, FIELDS, NUMERIC_TYPES, PARTITIONS, REQUIRED_FIELDS


def _conformance(df: DataFrame, columns: int, keys: int, missing: list[str], missing_keys: list[str],
                 status: str) -> DataFrame:
    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("records")).select(
        F.lit(columns).alias("schema_columns"),
        F.lit(keys).alias("partition_keys"),
        texts(missing).alias("missing_columns"),
        texts(missing_keys).alias("missing_partitions"),
        F.lit(status).alias("status"),
        "records",
    )


def schema_conformance(df: DataFrame, partition_columns: list[str], expected: list[str] | None = None,
                       expected_partitions: list[str] | None = None) -> DataFrame:
    """Expected against actual columns and partition keys: PASS, or PARTIAL with what is missing."""
    expected = expected if expected is not None else [*FIELDS, *DERIVED_TYPES]
    expected_partitions = expected_partitions if expected_partitions is not None else PARTITIONS
    columns = [c for c in expected if c not in df.columns]
    keys = [c for c in expected_partitions if c not in partition_columns]
    status = "PASS" if not columns and not keys else "PARTIAL"
    return _conformance(df, len(df.columns) - len(partition_columns), len(partition_columns), columns, keys, status)


def table_conformance(spark: SparkSession, name: str, **expected) -> DataFrame:
    """The same for a catalog table; FAIL if there is none."""
    if not spark.catalog.tableExists(name):
        return _conformance(spark.range(0), 0, 0, [], [], "FAIL")
    keys = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    return schema_conformance(spark.table(name), keys, **expected)


def _long(wide: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """One aggregated row with columns ``<measure>_<i>`` to one row per name."""
    rows = [
        F.struct(F.lit(n).alias("field"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
        for i, n in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


def column_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and non-null values of each expected column; a missing column has none."""
    wide = df.agg(
        *[F.count(F.lit(1)).alias(f"records_{i}") for i, _ in enumerate(columns)],
        *[(F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias(f"filled_{i}") for i, c in enumerate(columns)],
    )
    return _long(wide, columns, ["records", "filled"])


def field_completeness(raw: DataFrame, rules: str = "main", fields: list[str] | None = None) -> DataFrame:
    """Missing values and values of the wrong type per required field, over accepted raw records."""
    fields = fields or REQUIRED_FIELDS
    aggregates = []
    for i, name in enumerate(fields):
        raw_value = F.col(name)
        value = cleaning.clean(name, raw_value, rules)
        wrong = (
            raw_value.isNotNull() & raw_value.try_cast(NUMERIC_TYPES[name]).isNull()
            if name in NUMERIC_TYPES
            else F.lit(False)
        )
        aggregates += [
            F.count(F.lit(1)).alias(f"records_{i}"),
            F.count_if(value.isNull()).alias(f"missing_{i}"),
            F.count_if(wrong).alias(f"type_errors_{i}"),
        ]
    return _long(raw.agg(*aggregates), fields, ["records", "missing", "type_errors"])


def parse_validity(records: DataFrame) -> DataFrame:
    valid = F.col("reject_reason").isNull()
    return records.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(valid).alias("valid_lines"),
        F.count_if(~valid).alias("invalid_lines"),
    )


def invalid_lines(records: DataFrame, excerpt: int | None = None) -> DataFrame:
    """Every rejected line with the reason, and with its file and number if the lines carry them (``numbered_lines``).

    ``excerpt`` adds the start of a long line, for display.
    """
    line = F.col("line")
    origin = [c for c in ("file", "line_number") if c in records.columns]
    shown = [F.when(F.length(line) > excerpt, F.concat(F.substring(line, 1, excerpt), F.lit("..."))).otherwise(line).alias("excerpt")] if excerpt else []
    return records.where("reject_reason is not null").select(*origin, "line", F.col("reject_reason").alias("error"), *shown)


def group_count_check(lines: DataFrame, column: str = "value", layout: patterns.Layout | None = None,
                      names: list[str] | None = None) -> DataFrame:
    """Lines that match, and whether they yield as many groups as there are field names."""
    layout = layout or patterns.LAYOUTS["tolerant"]
    names = names or list(layout.fields)
    text = cleaning.strip(F.col(column))
    groups = F.size(F.col("raw.parts"))
    found = lines.where(text != "").select(evaluated_once({"parts": patterns.captured(text, layout)}).alias("raw"))
    matched = F.col("raw.parts").isNotNull()
    return found.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(matched).alias("matched"),
        F.count_if(~matched).alias("skipped"),
        F.count_if(matched & (groups == len(names))).alias("complete"),
        F.count_if(matched & (groups != len(names))).alias("partial"),
    )


def reconciled(lines: DataFrame, column: str = "value", named: str = "strict", numbered: str = "tolerant") -> DataFrame:
    """Both parsers on each line: which of them match, and the fields they disagree on.

    Both run on the same row, so no join by line is needed.
    """
    text = cleaning.strip(F.col(column))
    first, second = patterns.LAYOUTS[named], patterns.LAYOUTS[numbered]
    both = {"a": patterns.captured(text, first), "b": patterns.captured(text, second)}
    df = lines.select("*", evaluated_once(both).alias("raw"))
    a, b = F.col("raw.a"), F.col("raw.b")
    outcome = (
        F.when(a.isNotNull() & b.isNotNull(), "both")
        .when(a.isNotNull(), "named_only")
        .when(b.isNotNull(), "numbered_only")
        .otherwise("neither")
    )
    differs = []
    for name in FIELDS:
        left = cleaning.clean(name, a[first.fields.index(name)], "checker").cast("string")
        right = cleaning.clean_positional(b[second.fields.index(name)])
        differs.append(F.when(~left.eqNullSafe(right), F.lit(name)))
    return df.withColumn("outcome", outcome).withColumn(
        "differences", F.when(F.col("outcome") == "both", F.array_compact(F.array(*differs)))
    ).drop("raw")


def reconciliation_report(lines: DataFrame, **options) -> DataFrame:
    """Lines per outcome, and lines per field that the parsers disagree on, in one pass."""
    df = reconciled(lines, **options)
    entries = F.concat(
        F.array(F.struct(F.lit("outcome").alias("kind"), F.col("outcome").alias("name"))),
        F.transform(
            F.coalesce("differences", F.array().cast("array<string>")),
            lambda f: F.struct(F.lit("difference").alias("kind"), f.alias("name")),
        ),
    )
    return df.select(F.inline(entries)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("lines"))


def _truthy(column: str) -> Column:
    return F.when(F.col(column).cast("string") != "", F.col(column))


def data_profile(df: DataFrame) -> DataFrame:
    """Distinct contents, codes, methods and pools; range and mean of time and size without zeros."""
    out = []
    for name, column in (("response_time", "tiempo_respuesta_ms"), ("response_size", "tamano_respuesta")):
        value = F.when(F.col(column) != 0, F.col(column))
        out += [
            F.min(value).alias(f"min_{name}"),
            F.max(value).alias(f"max_{name}"),
            F.floor(F.sum(value) / F.count(value)).alias(f"mean_{name}"),
        ]
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(_truthy("content_type")).alias("content_types"),
        F.count_distinct(F.when(F.col("codigo_respuesta") != 0, F.col("codigo_respuesta"))).alias("response_codes"),
        F.count_distinct(_truthy("metodo")).alias("methods"),
        F.count_distinct(_truthy("ambiente_pool")).alias("pools"),
        *out,
    )


def value_sets(df: DataFrame) -> DataFrame:
    """Every distinct content type, code, method and pool with its number of records, sorted."""
    columns = ["content_type", "codigo_respuesta", "metodo", "ambiente_pool"]
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = values.unpivot([], columns, "field", "value").where("value is not null and value <> ''")
    long = long.where("not (field = 'codigo_respuesta' and value = '0')")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("records")).orderBy("field", "value")
