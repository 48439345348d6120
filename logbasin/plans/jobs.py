"""The named analytical jobs: request table in, small report out.

Every job takes the table and optional partition values (``year``, ``month``,
``day``, ``hour``). Reports that are cut to their first rows are ordered by all
their keys in the end, so the cut is always the same.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbasin.functions.classify import device_type
from logbasin.functions.health import origin_health, percent, pool_health
from logbasin.operators.filters import errors, where_period, where_time_range
from logbasin.operators.summary import filled, highest, lowest, number_of, summarize, total
from logbasin.session import new_folder

TIME = "tiempo_respuesta_ms"
SIZE = "tamano_respuesta"
CLIENT = "ip_cliente_externo"


def _names(keys: dict[str, str]) -> list[Column]:
    return [F.col(old).alias(new) for new, old in keys.items()]


def _keyed(df: DataFrame, keys: dict[str, str], *others: str) -> DataFrame:
    """The key columns under their report names, and the others a job needs."""
    return df.select(*_names(keys), *others)


def _rate(condition: Column) -> Column:
    return percent(F.count_if(condition), F.count(F.lit(1)))


def _cut(df: DataFrame, order: list[Column], ties: list[str], limit: int | None) -> DataFrame:
    ordered = df.orderBy(*order, *ties)
    return ordered if limit is None else ordered.limit(limit)


# -- errors --------------------------------------------------------------------


def _error_report(df, keys, time, limit, avg, p95, extra, **period):
    measures = {
        "_time": total(F.col(TIME)),
        "_timed": filled(F.col(TIME)),
        "first_error": lowest(F.col(time)),
        "last_error": highest(F.col(time)),
    }
    if extra:
        measures["total_bytes_served"] = total(F.col(SIZE))
    table = _keyed(errors(where_period(df, **period)), keys, TIME, SIZE, CLIENT, time)
    out = summarize(table, list(keys), TIME, {p95: 95}, measures, {"unique_clients": CLIENT} if extra else None)
    out = out.select(
        *keys,
        F.col("rows").alias("error_count"),
        (F.col("_time") / F.col("_timed")).alias(avg),
        p95,
        *(["unique_clients", "total_bytes_served"] if extra else []),
        "first_error",
        "last_error",
    )
    return _cut(out, [F.desc("error_count"), F.desc(avg)], list(keys), limit)


def error_analysis(df: DataFrame, limit: int | None = 50, **period) -> DataFrame:
    """Errors by node, pool, virtual server, category and code."""
    keys = {
        "f5_bigip": "entorno_nodo",
        "f5_pool": "ambiente_pool",
        "f5_virtualserver": "ambiente_origen",
        "status_category": "status_category",
        "codigo_respuesta": "codigo_respuesta",
    }
    return _error_report(
        df, keys, "parsed_timestamp_syslog", limit, "avg_response_time_ms", "p95_response_time_ms", True, **period
    )


def error_analysis_by_origin(df: DataFrame, limit: int | None = 100, **period) -> DataFrame:
    """The same errors, with the virtual server read as the device, by request time."""
    keys = {
        "bigip_device": "ambiente_origen",
        "pool_name": "ambiente_pool",
        "virtual_server": "entorno_nodo",
        "status_code": "codigo_respuesta",
        "status_category": "status_category",
    }
    return _error_report(
        df, keys, "parsed_timestamp_apache", limit, "avg_response_time", "p95_response_time", False, **period
    )


def origin_errors_day(df: DataFrame, **period) -> DataFrame:
    """Errors per origin within the given partitions."""
    return errors(where_period(df, **period)).groupBy("ambiente_origen").agg(F.count(F.lit(1)).alias("errors"))


def errors_by_pool(df: DataFrame, start: datetime, end: datetime, limit: int | None = 10,
                   slack: timedelta | None = None) -> DataFrame:
    out = errors(where_time_range(df, start, end, slack=slack)).groupBy(F.col("ambiente_pool").alias("pool_name"))
    return _cut(out.agg(F.count(F.lit(1)).alias("error_count")), [F.desc("error_count")], ["pool_name"], limit)


def error_timeline(df: DataFrame, start: datetime, end: datetime, bucket: str | None = None,
                   slack: timedelta | None = None) -> DataFrame:
    """Errors per request time, or per bucket of it (such as ``5 minutes``)."""
    time = F.col("parsed_timestamp_apache")
    time = F.window(time, bucket)["start"] if bucket else time
    out = errors(where_time_range(df, start, end, slack=slack)).groupBy(time.alias("time"))
    return out.agg(F.count(F.lit(1)).alias("errors")).orderBy("time")


# -- performance ---------------------------------------------------------------


def performance_analysis(df: DataFrame, limit: int | None = 100, min_requests: int = 10, **period) -> DataFrame:
    """Latency quantiles by node, pool, latency class, content class, device and cache."""
    keys = {
        "f5_bigip": "entorno_nodo",
        "f5_pool": "ambiente_pool",
        "response_time_category": "response_time_category",
        "content_category": "content_category",
        "is_mobile": "is_mobile",
        "cache_hit": "cache_hit",
    }
    table = _keyed(where_period(df, **period), keys, TIME, SIZE, "is_error")
    quantiles = {"p50_response_time_ms": 50, "p95_response_time_ms": 95, "p99_response_time_ms": 99}
    measures = {
        "_time": total(F.col(TIME)),
        "_timed": filled(F.col(TIME)),
        "_size": total(F.col(SIZE)),
        "_sized": filled(F.col(SIZE)),
        "error_count": number_of(F.col("is_error")),
    }
    out = summarize(table, list(keys), TIME, quantiles, measures).select(
        *keys,
        F.col("rows").alias("request_count"),
        (F.col("_time") / F.col("_timed")).alias("avg_response_time_ms"),
        *quantiles,
        (F.col("_size") / F.col("_sized")).alias("avg_response_size_bytes"),
        "error_count",
        percent(F.col("error_count"), F.col("rows")).alias("error_rate_percent"),
    )
    order = [F.desc("avg_response_time_ms"), F.desc("error_rate_percent")]
    return _cut(out.where(F.col("request_count") >= min_requests), order, list(keys), limit)


def performance_by_origin(df: DataFrame, limit: int | None = 50, **period) -> DataFrame:
    keys = {
        "bigip_device": "ambiente_origen",
        "pool_name": "ambiente_pool",
        "response_time_category": "response_time_category",
    }
    table = _keyed(where_period(df, **period), keys, TIME, "is_slow")
    quantiles = {"p50_response_time": 50, "p95_response_time": 95, "p99_response_time": 99}
    measures = {
        "_time": total(F.col(TIME)),
        "_timed": filled(F.col(TIME)),
        "slow_requests": number_of(F.col("is_slow")),
    }
    out = summarize(table, list(keys), TIME, quantiles, measures).select(
        *keys,
        F.col("rows").alias("request_count"),
        (F.col("_time") / F.col("_timed")).alias("avg_response_time"),
        *quantiles,
        "slow_requests",
        percent(F.col("slow_requests"), F.col("rows")).alias("slow_request_percentage"),
    )
    return _cut(out, [F.desc("avg_response_time")], list(keys), limit)


def slow_rate(df: DataFrame, start: datetime, end: datetime, slack: timedelta | None = None) -> DataFrame:
    """Share of slow requests in a time range, as a percentage."""
    return where_time_range(df, start, end, slack=slack).agg(_rate(F.col("is_slow")).alias("slow_rate"))


# -- pool health ---------------------------------------------------------------


def pool_health_monitoring(df: DataFrame, limit: int | None = 50, min_requests: int = 10, **period) -> DataFrame:
    """Health of each pool on each node, worst first."""
    keys = {"f5_pool": "ambiente_pool", "f5_bigip": "entorno_nodo"}
    code = F.col("codigo_respuesta")
    table = where_period(df, **period).where("ambiente_pool is not null")
    table = _keyed(table, keys, TIME, SIZE, "is_error", "codigo_respuesta", CLIENT)
    measures = {
        "_time": total(F.col(TIME)),
        "_timed": filled(F.col(TIME)),
        "max_response_time_ms": highest(F.col(TIME)),
        "error_count": number_of(F.col("is_error")),
        "server_errors": number_of(code >= 500),
        "client_errors": number_of((code >= 400) & (code < 500)),
        "total_bytes_served": total(F.col(SIZE)),
    }
    out = summarize(table, list(keys), TIME, {"p95_response_time_ms": 95}, measures, {"unique_clients": CLIENT})
    out = out.select(
        *keys,
        F.col("rows").alias("total_requests"),
        (F.col("_time") / F.col("_timed")).alias("avg_response_time_ms"),
        "p95_response_time_ms",
        "max_response_time_ms",
        "error_count",
        "server_errors",
        "client_errors",
        percent(F.col("error_count"), F.col("rows")).alias("error_rate_percent"),
        percent(F.col("server_errors"), F.col("rows")).alias("server_error_rate_percent"),
        "unique_clients",
        "total_bytes_served",
    ).withColumn("pool_health_score", pool_health(F.col("error_rate_percent"), F.col("avg_response_time_ms")))
    order = [F.asc("pool_health_score"), F.desc("error_rate_percent"), F.desc("avg_response_time_ms")]
    return _cut(out.where(F.col("total_requests") >= min_requests), order, list(keys), limit)


def pool_health_origin(df: DataFrame, limit: int | None = 100, min_requests: int = 10, **period) -> DataFrame:
    keys = {"bigip_device": "ambiente_origen", "pool_name": "ambiente_pool"}
    table = where_period(df, **period).where("ambiente_pool is not null")
    table = _keyed(table, keys, TIME, "is_error", "is_slow")
    measures = {
        "_time": total(F.col(TIME)),
        "_timed": filled(F.col(TIME)),
        "error_count": number_of(F.col("is_error")),
        "slow_requests": number_of(F.col("is_slow")),
    }
    out = summarize(table, list(keys), TIME, {"p95_response_time": 95}, measures).select(
        *keys,
        F.col("rows").alias("total_requests"),
        (F.col("_time") / F.col("_timed")).alias("avg_response_time"),
        "p95_response_time",
        "error_count",
        percent(F.col("error_count"), F.col("rows")).alias("error_rate"),
        "slow_requests",
        percent(F.col("slow_requests"), F.col("rows")).alias("slow_request_rate"),
    )
    health = origin_health(F.col("error_rate"), F.col("slow_request_rate"), F.col("avg_response_time"))
    out = out.withColumn("health_score", health).where(F.col("total_requests") >= min_requests)
    return _cut(out, [F.asc("health_score"), F.desc("error_rate")], list(keys), limit)


def pool_health_panel(df: DataFrame, start: datetime, end: datetime, slack: timedelta | None = None) -> DataFrame:
    """Health score per pool over a time range, worst first."""
    per_pool = where_time_range(df, start, end, slack=slack).groupBy(F.col("ambiente_pool").alias("pool_name")).agg(
        _rate(F.col("is_error")).alias("_errors"), _rate(F.col("is_slow")).alias("_slow"), F.avg(TIME).alias("_avg")
    )
    score = origin_health(F.col("_errors"), F.col("_slow"), F.col("_avg")).alias("health_score")
    return per_pool.select("pool_name", score).orderBy("health_score", "pool_name")


# -- traffic, clients, content ---------------------------------------------------


def request_summary(df: DataFrame, limit: int | None = 50, **period) -> DataFrame:
    keys = {"f5_bigip": "entorno_nodo", "f5_pool": "ambiente_pool"}
    out = where_period(df, **period).groupBy(*_names(keys)).agg(
        F.count(F.lit(1)).alias("request_count"), F.avg(TIME).alias("avg_response_time_ms")
    )
    return _cut(out, [F.desc("request_count")], list(keys), limit)


def traffic_distribution(df: DataFrame, limit: int | None = 100, **period) -> DataFrame:
    """Requests by origin, pool, node and method, with each group's share of all requests. Runs when it is called."""
    keys = {
        "bigip_device": "ambiente_origen",
        "pool_name": "ambiente_pool",
        "virtual_server": "entorno_nodo",
        "http_method": "metodo",
    }
    out = where_period(df, **period).groupBy(*_names(keys)).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(SIZE).alias("total_bytes_served"),
        F.avg(SIZE).alias("avg_response_size"),
        F.count_distinct(CLIENT).alias("unique_clients"),
    )
    # The groups are stored, so that requests are read once; their total is one number, not a window over all groups.
    folder = new_folder(df.sparkSession, "traffic")
    out.write.parquet(folder)
    out = df.sparkSession.read.schema(out.schema).parquet(folder)
    everything = out.agg(F.sum("request_count")).scalar()
    out = out.withColumn("traffic_percentage", percent(F.col("request_count"), everything))
    return _cut(out, [F.desc("request_count")], list(keys), limit)


def client_behavior(df: DataFrame, **period) -> DataFrame:
    out = where_period(df, **period).groupBy("is_mobile", "content_category").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_distinct(CLIENT).alias("unique_clients"),
        F.avg(TIME).alias("avg_response_time"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        _rate(F.col("cache_hit")).alias("cache_hit_rate"),
        F.count_if(F.col("is_error")).alias("error_count"),
        _rate(F.col("is_error")).alias("error_rate"),
    )
    out = out.withColumn("device_type", device_type(F.col("is_mobile"))).drop("is_mobile")
    return out.orderBy(F.desc("request_count"), "device_type", "content_category")


def content_performance(df: DataFrame, limit: int | None = 50, **period) -> DataFrame:
    """Cache use and latency with and without it, by content."""
    keys = ["content_category", "content_type"]
    out = where_period(df, **period).where("content_type is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        _rate(F.col("cache_hit")).alias("cache_hit_rate"),
        F.avg(TIME).alias("avg_response_time"),
        F.avg(F.when(F.col("cache_hit"), F.col(TIME))).alias("avg_cached_response_time"),
        F.avg(F.when(~F.col("cache_hit"), F.col(TIME))).alias("avg_uncached_response_time"),
        F.sum(SIZE).alias("total_bytes_served"),
        F.avg(SIZE).alias("avg_response_size"),
    )
    return _cut(out, [F.desc("total_requests"), F.asc("cache_hit_rate")], keys, limit)


def hourly_summary(df: DataFrame, **period) -> DataFrame:
    keys = ["year", "month", "day", "hour"]
    table = where_period(df, **period).select(
        *keys, TIME, SIZE, CLIENT, "ambiente_origen", "ambiente_pool", "is_error", "cache_hit"
    )
    measures = {
        "_time": total(F.col(TIME)),
        "_timed": filled(F.col(TIME)),
        "error_count": number_of(F.col("is_error")),
        "cache_hits": number_of(F.col("cache_hit")),
        "total_bytes_served": total(F.col(SIZE)),
    }
    distinct = {
        "unique_clients": CLIENT,
        "active_bigip_devices": "ambiente_origen",
        "active_pools": "ambiente_pool",
    }
    out = summarize(table, keys, TIME, {"p95_response_time": 95}, measures, distinct)
    return out.select(
        *keys,
        F.col("rows").alias("total_requests"),
        *distinct,
        (F.col("_time") / F.col("_timed")).alias("avg_response_time"),
        "p95_response_time",
        "error_count",
        percent(F.col("error_count"), F.col("rows")).alias("error_rate"),
        "cache_hits",
        percent(F.col("cache_hits"), F.col("rows")).alias("cache_hit_rate"),
        "total_bytes_served",
    ).orderBy(*keys)


def partition_distribution(df: DataFrame) -> DataFrame:
    out = df.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("record_count"))
    return out.orderBy(F.desc("year"), F.desc("month"), F.desc("day"))


def traffic_metrics(df: DataFrame, period: str = "5 minutes", time: str = "parsed_timestamp_syslog") -> DataFrame:
    """Mobile share, cache hit rate and requests per second in each time window."""
    window = F.window(time, period)
    seconds = F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))
    out = df.groupBy(window.alias("w")).agg(
        _rate(F.col("is_mobile")).alias("mobile_traffic_percentage"),
        _rate(F.col("cache_hit")).alias("cache_hit_rate"),
        F.count(F.lit(1)).alias("requests"),
    )
    return out.select(
        F.col("w.start").alias("window_start"),
        "mobile_traffic_percentage",
        "cache_hit_rate",
        (F.col("requests") / seconds).alias("request_volume"),
    )


# -- ingest reports ----------------------------------------------------------------


def etl_error_stats(df: DataFrame) -> DataFrame:
    """Totals and rates over a classified batch."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("codigo_respuesta") >= 400).alias("error_records"),
        F.count_if(F.col("tiempo_respuesta_ms") > 5000).alias("slow_records"),
        _rate(F.col("codigo_respuesta") >= 400).alias("error_rate"),
        _rate(F.col("tiempo_respuesta_ms") > 5000).alias("slow_rate"),
    )


def etl_format_stats(records: DataFrame) -> DataFrame:
    """Formats met and records parsed, over the output of ``parse_lines``."""
    ok = F.col("reject_reason").isNull()
    known = F.col("record_format") != "unknown"
    return records.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("record_format") == "json").alias("json_records"),
        F.count_if(F.col("record_format") == "text").alias("text_records"),
        F.count_if(ok).alias("parsed_successfully"),
        F.count_if(known & ~ok).alias("parsing_errors"),
        F.count_if(~known).alias("format_detection_errors"),
        _rate(ok).alias("success_rate"),
    )


def volume_metrics(records: DataFrame) -> DataFrame:
    """Processed, flagged, per-format and fully enriched counts of one batch of classified records."""
    ok = F.col("reject_reason").isNull()
    enriched = ok & F.col("parsed_timestamp_syslog").isNotNull() & (F.col("status_category") != "unknown")
    return records.agg(
        F.count(F.lit(1)).alias("logs_processed"),
        F.count_if(F.col("needs_alert") & ok).alias("error_logs_filtered"),
        F.count_if(ok & (F.col("record_format") == "json")).alias("json_format_detected"),
        F.count_if(ok & (F.col("record_format") == "text")).alias("text_format_detected"),
        F.count_if(enriched).alias("enrichment_success"),
    )
