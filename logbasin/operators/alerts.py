"""Records worth an alert, and the pool metrics taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbasin.functions import classify
from logbasin.functions.health import percent, stream_health
from logbasin.operators.parse import raw_records
from logbasin.operators.summary import Measure, nearest_rank, number_of, ranked, summarize, total
from logbasin.schema import FIELDS, NUMERIC_TYPES, OTHER_NAMES

NOT_IN_ALERTS = ("usuario_autenticado", "identidad", "campo_reservado_2")


def alert_records(lines: DataFrame, column: str = "value", layout: str = "tolerant",
                  faithful_keywords: bool = False, passing: str | None = None) -> DataFrame:
    """Requests with a 4xx/5xx code, a slow or a large response, and other lines with an error keyword.

    Envelopes are unwrapped first. A JSON record is judged by its fields; in a JSON
    object that is no access record the values are searched, not the key names. With
    ``faithful_keywords`` it is searched for keywords as text instead, as the
    existing filter does, so that a key such as ``is_error`` flags it. Rows whose column ``passing`` is set are kept too,
    alert or not.
    """
    raw = raw_records(lines, column, layout, unwrap=True, min_length=0)
    kept = [c for c in lines.columns if c != column]
    has_fields = F.col("reject_reason").isNull()
    if faithful_keywords:
        has_fields = has_fields & (F.col("record_format") == "text")
        searched = ~has_fields
    else:
        searched = ~has_fields
    numbers = {n: F.col(n).try_cast(t) for n, t in NUMERIC_TYPES.items()}
    code, time_ms, size = (
        numbers["codigo_respuesta"], numbers["tiempo_respuesta_ms"], numbers["tamano_respuesta"]
    )
    by_fields = has_fields & classify.needs_alert(code, time_ms, size)
    text = F.col("line")
    if not faithful_keywords:
        values = F.array_join(F.map_values(F.from_json("line", "map<string,string>")), "\n")
        text = F.when(F.col("record_format") == "json", values).otherwise(text)
    keywords = F.when(searched, classify.detected_keywords(text))
    judged = raw.select(
        *kept,
        F.col("line").alias("original_log"),
        F.when(by_fields, "f5_access").when(F.size(keywords) > 0, "f5_generic_error").alias("log_type"),
        keywords.alias("detected_keywords"),
        *[numbers.get(n, F.col(n)).alias(OTHER_NAMES.get(n, n)) for n in FIELDS if n not in NOT_IN_ALERTS],
    ).where(F.col("log_type").isNotNull() | F.col(passing).isNotNull() if passing else F.col("log_type").isNotNull())
    access = F.col("log_type") == "f5_access"
    code, time_ms, size = F.col("codigo_respuesta"), F.col("tiempo_respuesta_ms"), F.col("tamano_respuesta")
    fields = [OTHER_NAMES.get(n, n) for n in FIELDS if n not in NOT_IN_ALERTS]
    return judged.select(
        *kept,
        F.current_timestamp().alias("timestamp"),
        "original_log",
        "log_type",
        F.when(access, classify.error_reasons(code, time_ms, size))
        .otherwise(F.array(F.lit("Contains error keyword")))
        .alias("error_reasons"),
        F.struct(
            *[F.when(access, F.col(n)).alias(n) for n in fields],
            F.when(access, classify.error_category(code, time_ms, size)).alias("error_category"),
            F.when(~access, F.lit(True)).alias("contains_error_keyword"),
            F.when(~access, F.col("detected_keywords")).alias("detected_keywords"),
        ).alias("parsed_data"),
    )


METRIC_UNITS = {
    "RequestCount": "Count",
    "AverageResponseTime": "Milliseconds",
    "P95ResponseTime": "Milliseconds",
    "ErrorRate": "Percent",
    "PoolHealthScore": "Percent",
}
DIMENSIONS = ["F5Environment", "Pool", "VirtualServer"]


def _with_units(wide: DataFrame, ids: list[str]) -> DataFrame:
    """One row per metric."""
    long = wide.unpivot(
        ids, [F.col(m).cast("double").alias(m) for m in METRIC_UNITS], "metric", "value"
    )
    unit = F.create_map(*[F.lit(x) for pair in METRIC_UNITS.items() for x in pair])
    return long.withColumn("unit", unit[F.col("metric")])


def flagged_requests(alerts: DataFrame) -> DataFrame:
    """Alert rows as metric input; a keyword hit has no fields and counts under UNKNOWN."""
    data = F.col("parsed_data")
    return alerts.select(
        F.coalesce(data["f5_bigip_name"], F.lit("UNKNOWN")).alias("F5Environment"),
        F.coalesce(data["f5_pool"], F.lit("UNKNOWN")).alias("Pool"),
        F.coalesce(data["f5_virtualserver"], F.lit("UNKNOWN")).alias("VirtualServer"),
        F.coalesce(data["tiempo_respuesta_ms"], F.lit(0)).alias("time_ms"),
        F.coalesce(data["codigo_respuesta"], F.lit(0)).alias("code"),
    )


def all_requests(table: DataFrame, *others: str | Column) -> DataFrame:
    """The whole request table as metric input."""
    return table.select(
        *others,
        F.coalesce("entorno_nodo", F.lit("UNKNOWN")).alias("F5Environment"),
        F.coalesce("ambiente_pool", F.lit("UNKNOWN")).alias("Pool"),
        F.coalesce("ambiente_origen", F.lit("UNKNOWN")).alias("VirtualServer"),
        F.coalesce("tiempo_respuesta_ms", F.lit(0)).alias("time_ms"),
        F.coalesce("codigo_respuesta", F.lit(0)).alias("code"),
    )


def _is_slow() -> Column:
    return F.col("time_ms") > classify.SLOW_MS


def _measures() -> dict[str, Measure]:
    return {
        "_time": total(F.col("time_ms")),
        "_errors": number_of(classify.has_error_digit(F.col("code"))),
        "_slow": number_of(_is_slow()),
    }


def pool_metrics(requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, P95, error rate and health of each (node, pool, virtual server)."""
    keys = [*(keys or []), *DIMENSIONS]
    table = requests.select(*keys, "time_ms", "code")
    return _metrics(summarize(table, keys, "time_ms", {"P95ResponseTime": 95}, _measures(), rank=nearest_rank), keys)


def _metrics(summary: DataFrame, keys: list[str]) -> DataFrame:
    error_rate, slow_rate = percent(F.col("_errors"), F.col("rows")), percent(F.col("_slow"), F.col("rows"))
    wide = summary.select(
        *keys,
        F.col("rows").alias("RequestCount"),
        (F.col("_time") / F.col("rows")).alias("AverageResponseTime"),
        "P95ResponseTime",
        error_rate.alias("ErrorRate"),
        stream_health(error_rate, slow_rate).alias("PoolHealthScore"),
    )
    return _with_units(wide, keys)


WINDOW = ["window_start", "window_end"]


def window_histogram(requests: DataFrame, time: str, period: str = "5 minutes") -> DataFrame:
    """How often each response time occurs per window and pool: parts of it can be added up, at any split of the rows."""
    keyed = requests.select("*", *_window(time, period))
    return keyed.groupBy(*WINDOW, *DIMENSIONS, "time_ms").agg(F.count(F.lit(1)).alias("n"), *[m.of_rows().alias(c) for c, m in _measures().items()])


def merged_histogram(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*WINDOW, *DIMENSIONS, "time_ms").agg(F.sum("n").alias("n"), *[m.of_parts(F.col(c)).alias(c) for c, m in _measures().items()])


def histogram_metrics(parts: DataFrame) -> DataFrame:
    """The pool metrics of windows from parts of their histograms: those of ``windowed_pool_metrics`` over the same rows."""
    keys = [*WINDOW, *DIMENSIONS]
    whole = merged_histogram(parts).withColumnsRenamed({"time_ms": "_v", "n": "_n"})
    return _metrics(ranked(whole, keys, {"P95ResponseTime": 95}, _measures(), rank=nearest_rank), keys)


def _window(time: str, period: str) -> list[Column]:
    w = F.window(time, period)
    return [w["start"].alias("window_start"), w["end"].alias("window_end")]


def windowed_pool_metrics(requests: DataFrame, time: str, period: str = "5 minutes") -> DataFrame:
    """The pool metrics per tumbling window, P95 by nearest rank as without windows."""
    return pool_metrics(requests.select("*", *_window(time, period)), ["window_start", "window_end"])


def _rates() -> tuple[Column, Column]:
    rows = F.count(F.lit(1))
    return percent(F.count_if(classify.has_error_digit(F.col("code"))), rows), percent(F.count_if(_is_slow()), rows)


def windowed_health(requests: DataFrame, time: str, period: str) -> DataFrame:
    """Only the health score of each (node, pool, virtual server) per window."""
    keyed = requests.select(*_window(time, period), *DIMENSIONS, "time_ms", "code")
    return keyed.groupBy("window_start", "window_end", *DIMENSIONS).agg(stream_health(*_rates()).alias("PoolHealthScore"))
