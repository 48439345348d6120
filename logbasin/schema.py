"""Names and types of the request table.

One wide, flat table: a row per HTTP request, partitioned by hour.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The 22 source fields, in the order they stand in a line.
FIELDS = [
    "timestamp_syslog",
    "hostname",
    "ip_cliente_externo",
    "ip_red_interna",
    "usuario_autenticado",
    "identidad",
    "timestamp_apache",
    "metodo",
    "recurso",
    "protocolo",
    "codigo_respuesta",
    "tamano_respuesta",
    "referer",
    "user_agent",
    "tiempo_respuesta_ms",
    "edad_cache",
    "content_type",
    "campo_reservado_1",
    "campo_reservado_2",
    "ambiente_origen",
    "ambiente_pool",
    "entorno_nodo",
]

# The second vocabulary in use, canonical name -> other name.
OTHER_NAMES = {
    "ip_red_interna": "ip_backend_interno",
    "timestamp_apache": "timestamp_rp",
    "recurso": "request",
    "campo_reservado_1": "jsession_id",
    "ambiente_origen": "f5_virtualserver",
    "ambiente_pool": "f5_pool",
    "entorno_nodo": "f5_bigip_name",
}

# Keys a JSON record must carry (their value may be null).
REQUIRED_KEYS = ["timestamp_syslog", "hostname", "ip_cliente_externo"]

# Fields that every stored record should fill.
REQUIRED_FIELDS = [
    "timestamp_syslog",
    "hostname",
    "ip_cliente_externo",
    "ip_red_interna",
    "metodo",
    "recurso",
    "protocolo",
    "codigo_respuesta",
    "tamano_respuesta",
    "user_agent",
    "tiempo_respuesta_ms",
    "ambiente_origen",
    "ambiente_pool",
    "entorno_nodo",
]

NUMERIC_TYPES = {
    "codigo_respuesta": "int",
    "tamano_respuesta": "bigint",
    "tiempo_respuesta_ms": "bigint",
}

PARTITIONS = ["year", "month", "day", "hour"]

DERIVED_TYPES = {
    "parsed_timestamp_syslog": "timestamp_ntz",
    "parsed_timestamp_apache": "timestamp_ntz",
    "is_error": "boolean",
    "status_category": "string",
    "is_slow": "boolean",
    "response_time_category": "string",
    "is_mobile": "boolean",
    "content_category": "string",
    "cache_hit": "boolean",
    "processing_timestamp": "timestamp",
    "etl_version": "string",
}


def field_type(name: str) -> str:
    return NUMERIC_TYPES.get(name, "string")


def table_ddl(partitions: bool = True) -> str:
    """Column list of the request table: 22 source, 11 derived, 4 partition columns."""
    columns = [f"{n} {field_type(n)}" for n in FIELDS]
    columns += [f"{n} {t}" for n, t in DERIVED_TYPES.items()]
    if partitions:
        columns += [f"{n} int" for n in PARTITIONS]
    return ", ".join(columns)


def table_schema() -> T.StructType:
    return T.StructType.fromDDL(table_ddl())


def json_record_schema() -> T.StructType:
    """All-string view of a JSON record: either vocabulary, or an envelope."""
    names = FIELDS + list(OTHER_NAMES.values()) + ["message"]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
