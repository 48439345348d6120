from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logbasin.functions import classify, health
from logbasin.functions.classify import LARGE_BYTES, PROFILES
from logbasin.operators import enrich


def evaluate(spark, kind, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


CODES = [None, 0, 100, 299, 300, 399, 400, 499, 500, 599]


@pytest.mark.parametrize("profile, labels", [
    ("main", ["unknown", "unknown", "unknown", "success", "redirect", "redirect", "client_error", "client_error",
              "server_error", "server_error"]),
    ("legacy_udf", ["unknown", "unknown", "unknown", "success", "redirect", "redirect", "client_error",
                    "client_error", "server_error", "server_error"]),
    ("legacy_native", ["Server Error", "Success", "Success", "Success", "Redirect", "Redirect", "Client Error",
                       "Client Error", "Server Error", "Server Error"]),
    ("bridge", ["server_error", "success", "success", "success", "redirect", "redirect", "client_error",
                "client_error", "server_error", "server_error"]),
])
def test_status_category(spark, profile, labels):
    assert evaluate(spark, "int", CODES, lambda c: classify.status_category(c, PROFILES[profile])) == labels


TIMES = [None, 0, 99, 100, 499, 500, 999, 1000, 1999, 2000, 4999, 5000, 5001]


@pytest.mark.parametrize("profile, labels", [
    ("main", ["unknown"] * 2 + ["fast"] + ["normal"] * 4 + ["slow"] * 4 + ["very_slow"] * 2),
    ("legacy_udf", ["unknown"] * 2 + ["fast"] + ["normal"] * 2 + ["slow"] * 4 + ["critical"] * 4),
    ("legacy_native", ["Slow"] + ["Fast"] * 6 + ["Normal"] * 4 + ["Slow"] * 2),
    ("bridge", ["very_slow"] + ["fast"] * 2 + ["normal"] * 2 + ["slow"] * 2 + ["very_slow"] * 6),
])
def test_response_time_category(spark, profile, labels):
    assert evaluate(spark, "bigint", TIMES, lambda c: classify.response_time_category(c, PROFILES[profile])) == labels


@pytest.mark.parametrize("profile, slow, error_of_null", [
    ("main", [False] * 12 + [True], False),
    ("legacy_native", [None] + [False] * 11 + [True], None),
    ("bridge", [None] + [False] * 7 + [True] * 5, None),
])
def test_slow_and_error_flags(spark, profile, slow, error_of_null):
    rules = PROFILES[profile]
    assert evaluate(spark, "bigint", TIMES, lambda c: classify.is_slow(c, rules)) == slow
    flags = evaluate(spark, "int", [None, 0, 399, 400], lambda c: classify.is_error(c, rules))
    assert flags == [error_of_null, False, False, True]


def test_mobile(spark):
    agents = [None, "", "x Mobile", "x mobile", "iPad", "Windows Phone", "Opera Mini", "desktop"]
    assert evaluate(spark, "string", agents, lambda c: classify.is_mobile(c, PROFILES["main"])) == [
        False, False, True, False, True, True, False, False]
    assert evaluate(spark, "string", agents, lambda c: classify.is_mobile(c, PROFILES["legacy_udf"])) == [
        False, False, True, True, True, True, True, False]
    assert evaluate(spark, "string", agents, lambda c: classify.is_mobile(c, PROFILES["unquoted"])) == [
        False, False, True, False, False, False, False, False]


def test_content(spark):
    types = [None, "", "application/javascript", "text/css", "IMAGE/png", "image/png", "text/html", "application/json",
             "application/xml", "font/woff2", "video/mp4", "audio/ogg", "application/pdf", "x/api", "x/y"]
    assert evaluate(spark, "string", types, lambda c: classify.content_category(c, PROFILES["main"])) == [
        "unknown", "unknown", "js", "css", "other", "image", "html", "api",
        "other", "other", "other", "other", "other", "api", "other"]
    assert evaluate(spark, "string", types, lambda c: classify.content_category(c, PROFILES["legacy_udf"])) == [
        "unknown", "unknown", "javascript", "css", "image", "image", "html", "api",
        "api", "font", "video", "audio", "document", "other", "other"]


def test_cache(spark):
    ages = [None, "", "-", "0", "120", '""']
    assert evaluate(spark, "string", ages, lambda c: classify.cache_hit(c, PROFILES["main"])) == [
        False, False, False, True, True, True]
    assert evaluate(spark, "string", ages, lambda c: classify.cache_hit(c, PROFILES["legacy_udf"])) == [
        False, False, True, True, True, False]
    assert evaluate(spark, "string", ages, lambda c: classify.cache_hit(c, PROFILES["unquoted"])) == [
        False, False, False, False, True, False]


def test_path_features(spark):
    paths = [None, "", "-", "/", "/a/b.js?v=1.2", "host/a//b.tar.GZ", "nothing"]
    assert evaluate(spark, "string", paths, classify.request_domain) == [None, None, None, "", "", "host", "nothing"]
    assert evaluate(spark, "string", paths, classify.request_path_depth) == [0, 0, 0, 0, 2, 3, 1]
    assert evaluate(spark, "string", paths, classify.file_extension) == [None, None, None, None, "2", "gz", None]


def alerts_of(spark, code, ms, size):
    df = spark.createDataFrame([(code, ms, size)], "c int, m bigint, s bigint")
    columns = [F.col("c"), F.col("m"), F.col("s")]
    return df.select(
        classify.error_reasons(*columns).alias("r"),
        classify.error_category(*columns).alias("k"),
        classify.needs_alert(*columns).alias("n"),
    ).collect()[0]


@pytest.mark.parametrize("code, ms, size, reasons, category", [
    (200, 5000, LARGE_BYTES, [], "unknown"),
    (404, 1, 1, ["HTTP 404 (client_error)"], "client_error"),
    (45, 1, 1, ["HTTP 45 (client_error)"], "unknown"),
    (5, 1, 1, ["HTTP 5 (server_error)"], "unknown"),
    (503, 5001, LARGE_BYTES + 1, [
        "HTTP 503 (server_error)", "Slow response: 5001ms (threshold: 5000ms)",
        "Large response: 10485761 bytes (threshold: 10485760 bytes)",
    ], "server_error,performance_slow,performance_large"),
    (600, 1, 1, [], "server_error"),
])
def test_alert_texts(spark, code, ms, size, reasons, category):
    row = alerts_of(spark, code, ms, size)
    assert (row.r, row.k, row.n) == (reasons, category, bool(reasons))


def test_keywords(spark):
    found = evaluate(spark, "string", ["it Failed with an exception", "fine", "", "error ERROR"], classify.detected_keywords)
    assert found == [["EXCEPTION", "FAILED"], [], [], ["ERROR"]]


def test_health_scores(spark):
    df = spark.createDataFrame([(10.0, 20.0, 400.0), (90.0, 80.0, 99999.0)], "e double, s double, a double")
    e, s, a = F.col("e"), F.col("s"), F.col("a")
    rows = df.select(health.stream_health(e, s), health.pool_health(e, a), health.origin_health(e, s, a)).collect()
    assert [tuple(r) for r in rows] == [(80.0, 86.0, 40.0), (0.0, 0.0, 0.0)]


def test_time_divisor(spark):
    df = spark.createDataFrame(
        [(200, 6_000_000, 1, "", "", "", "", "")],
        "codigo_respuesta int, tiempo_respuesta_ms bigint, tamano_respuesta bigint, user_agent string,"
        " content_type string, edad_cache string, recurso string, entorno_nodo string",
    )
    assert enrich.enrich(df, time_divisor=1000).collect()[0].response_time_category == "very_slow"
    assert enrich.enrich(df, time_divisor=1000).collect()[0].tiempo_respuesta_ms == 6000
