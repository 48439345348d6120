"""Derived columns of a typed record, by profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbasin.functions import classify
from logbasin.functions.classify import PROFILES
from logbasin.schema import DERIVED_TYPES, FIELDS, PARTITIONS


def enrich(df: DataFrame, profile: str = "main", time_divisor: int = 1) -> DataFrame:
    """Add the classification columns of a profile.

    ``time_divisor`` brings response times to milliseconds where the source
    reports a finer unit (1000 for microseconds).
    """
    rules = PROFILES[profile]
    code = F.col("codigo_respuesta")
    if time_divisor != 1:
        df = df.withColumn("tiempo_respuesta_ms", F.floor(F.col("tiempo_respuesta_ms") / time_divisor))
    time_ms = F.col("tiempo_respuesta_ms")
    columns = {
        "is_error": classify.is_error(code, rules),
        "status_category": classify.status_category(code, rules),
        "is_slow": classify.is_slow(time_ms, rules),
        "response_time_category": classify.response_time_category(time_ms, rules),
    }
    if rules.mobile_tokens:
        columns["is_mobile"] = classify.is_mobile(F.col("user_agent"), rules)
        columns["content_category"] = classify.content_category(F.col("content_type"), rules)
        columns["cache_hit"] = classify.cache_hit(F.col("edad_cache"), rules)
    if profile == "legacy_udf":
        columns["is_large"] = classify.is_large(F.col("tamano_respuesta"))
        columns["request_domain"] = classify.request_domain(F.col("recurso"))
        columns["request_path_depth"] = classify.request_path_depth(F.col("recurso"))
        columns["file_extension"] = classify.file_extension(F.col("recurso"))
        columns["f5_environment"] = classify.environment(F.col("entorno_nodo"))
    if profile == "legacy_native":
        columns["processing_date"] = F.current_date()
    if profile == "bridge":
        columns["processed_at"] = F.current_timestamp()
        columns["log_type"] = F.lit("f5_access")
        columns["processor_version"] = F.lit(rules.version)
    else:
        columns["processing_timestamp"] = F.current_timestamp()
        columns["etl_version"] = F.lit(rules.version)
    return df.withColumns(columns)


def request_table(accepted: DataFrame) -> DataFrame:
    """Exactly the columns of the stored table, in order."""
    return enrich(accepted).select(*FIELDS, *DERIVED_TYPES, *PARTITIONS)


def ingest_envelope(lines: DataFrame, log_type: str = "f5_access", processed_by: str = "spark",
                    agent_version: str = "1") -> DataFrame:
    """Wrap raw lines with the metadata a collecting agent adds."""
    return lines.select(
        F.to_json(
            F.struct(
                F.col("value").alias("message"),
                F.lit(log_type).alias("log_type"),
                F.current_timestamp().cast("string").alias("processed_at"),
                F.lit(processed_by).alias("processed_by"),
                F.lit(agent_version).alias("agent_version"),
            )
        ).alias("value")
    )
