from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logbasin.operators import alarms, alerts, filters, quality
from logbasin.operators.alarms import ALARMS, Alarm
from logbasin.operators.summary import filled, highest, lowest, nearest_rank, number_of, summarize, total
from logbasin.plans import etl, jobs


def brute(rows, percent, nearest):
    values = sorted(v for v in rows if v is not None)
    if not values:
        return None
    n = len(values)
    rank = min(percent * n // 100 + 1, n) if nearest else max(1, -(-percent * n // 100))
    return values[rank - 1]


@pytest.mark.parametrize("nearest", [False, True])
def test_summary_against_brute_force(spark, nearest):
    """A third of all rows share one key, and keys, values and clients may be null."""
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rnd.choice([None, "a", "b", "c", "one"]) if i > 5 else "one"
        rows.append((key, rnd.choice([None, *range(40)]), rnd.choice([None, *"xyz"]), rnd.choice([1, 2])))
    rows += [("twenty", v, "x", 1) for v in range(20)] + [("empty", None, None, 1)] * 3
    df = spark.createDataFrame(rows, "k string, v bigint, d string, e int")
    kwargs = {"rank": nearest_rank} if nearest else {}
    out = summarize(
        df, ["k"], "v", {"p50": 50, "p95": 95},
        {"sum": total(F.col("v")), "n": filled(F.col("v")), "lo": lowest(F.col("v")), "hi": highest(F.col("v")),
         "big": number_of(F.col("v") > 30)},
        {"ds": "d", "es": "e"}, **kwargs,
    )
    found = {r.k: r.asDict() for r in out.collect()}
    assert set(found) == {r[0] for r in rows}
    for key, got in found.items():
        mine = [r for r in rows if r[0] == key]
        values = [r[1] for r in mine if r[1] is not None]
        assert got == {
            "k": key, "rows": len(mine), "sum": sum(values) if values else None, "n": len(values),
            "lo": min(values, default=None), "hi": max(values, default=None), "big": sum(v > 30 for v in values),
            "ds": len({r[2] for r in mine} - {None}), "es": len({r[3] for r in mine}),
            "p50": brute([r[1] for r in mine], 50, nearest), "p95": brute([r[1] for r in mine], 95, nearest),
        }
    if nearest:
        assert found["twenty"]["p95"] == 19
    else:
        assert found["twenty"]["p95"] == 18


def test_summary_shuffles_pairs_before_keys(spark):
    """Nothing is brought together by key before it is one row per value."""
    df = spark.range(100).selectExpr("id % 3 as k", "id as v", "id % 7 as d")
    plan = summarize(df, ["k"], "v", {"p": 95}, {}, {"ds": "d"})._jdf.queryExecution().executedPlan().toString()
    first = [row for row in plan.splitlines() if "Exchange hashpartitioning" in row][-1]
    assert "_v" in first and "_d0" in first
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def requests(spark, rows):
    """(second, code, ms, pool) on one node."""
    data = [(datetime(2025, 8, 8) + timedelta(seconds=s), c, m, p) for s, c, m, p in rows]
    df = spark.createDataFrame(data, "parsed_timestamp_syslog timestamp_ntz, codigo_respuesta int, tiempo_respuesta_ms bigint, ambiente_pool string")
    return df.selectExpr(
        "*", "parsed_timestamp_syslog as parsed_timestamp_apache", "'n' as entorno_nodo", "'o' as ambiente_origen",
        "codigo_respuesta >= 400 as is_error", "tiempo_respuesta_ms > 5000 as is_slow", "year(parsed_timestamp_syslog) as year",
        "month(parsed_timestamp_syslog) as month", "day(parsed_timestamp_syslog) as day", "hour(parsed_timestamp_syslog) as hour",
    )


def test_minimum_requests_and_health(spark):
    table = requests(spark, [(i, 500 if i < 5 else 200, 1000, "p") for i in range(10)] + [(1, 200, 1, "few")])
    out = jobs.pool_health_origin(table, year=2025, month="08").collect()
    assert [(r.pool_name, r.error_rate, r.health_score) for r in out] == [("p", 50.0, 0.0)]
    assert jobs.pool_health_origin(table, min_requests=1).count() == 2
    assert jobs.pool_health_origin(table, year=2024).count() == 0


def test_top_rows_are_stable(spark):
    table = requests(spark, [(i, 500, 10, f"p{i % 7}") for i in range(70)])
    span = (datetime(2025, 8, 1), datetime(2025, 8, 31))
    assert [r.pool_name for r in jobs.errors_by_pool(table, *span, limit=3).collect()] == ["p0", "p1", "p2"]


def test_time_range_prunes_hours(spark, tmp_path):
    table = requests(spark, [(3600 * h, 200, 1, "p") for h in range(24)])
    path = str(tmp_path / "t")
    table.write.partitionBy("year", "month", "day", "hour").parquet(path)
    start, end = datetime(2025, 8, 8, 3), datetime(2025, 8, 8, 5, 30)
    stored = spark.read.parquet(path)
    exact = filters.where_time_range(stored, start, end, "parsed_timestamp_syslog")
    assert exact.count() == 3
    scan = exact._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "hour" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert filters.where_time_range(stored, start, end, slack=timedelta(hours=1)).count() == 3
    loose = filters.where_time_range(stored, start, end)._jdf.queryExecution().executedPlan().toString()
    assert "hour" not in loose.split("PartitionFilters: [")[1].split("]")[0]


def test_reports_read_only_their_columns(spark, tmp_path):
    table = requests(spark, [(1, 200, 1, "p")]).withColumn("user_agent", F.lit("x" * 100))
    path = str(tmp_path / "t")
    table.write.partitionBy("year", "month", "day", "hour").parquet(path)
    plan = jobs.request_summary(spark.read.parquet(path), year=2025, month="8")._jdf.queryExecution().executedPlan().toString()
    columns = plan.split("ReadSchema: struct<")[1]
    assert "user_agent" not in columns and "tiempo_respuesta_ms" in columns


def test_pool_metrics_of_flagged_lines(spark, lines, line):
    slow = line.replace("Time 4213", "Time 9000")
    bad = line.replace("1.1\" 200", "1.1\" 503")
    noise = "kernel: write FAILED on device"
    found = alerts.alert_records(lines(line, slow, bad, noise, "all is well"))
    rows = {r.original_log: r for r in found.collect()}
    assert set(rows) == {slow, bad, noise}
    assert rows[noise].log_type == "f5_generic_error" and rows[noise].parsed_data.detected_keywords == ["FAILED"]
    assert rows[bad].parsed_data.error_category == "server_error" and rows[bad].parsed_data.contains_error_keyword is None
    metrics = {(r.Pool, r.metric): r.value for r in alerts.pool_metrics(alerts.flagged_requests(found)).collect()}
    assert metrics[("/Portal/Pool_1", "RequestCount")] == 2
    assert metrics[("/Portal/Pool_1", "ErrorRate")] == 50 and metrics[("/Portal/Pool_1", "PoolHealthScore")] == 25
    assert metrics[("/Portal/Pool_1", "P95ResponseTime")] == 9000
    assert metrics[("UNKNOWN", "RequestCount")] == 1 and metrics[("UNKNOWN", "AverageResponseTime")] == 0


def windows(spark, values, period=300):
    start = datetime(2025, 8, 8)
    rows = [(start + timedelta(seconds=period * i), v) for i, v in values.items()]
    return spark.createDataFrame(rows, "window_start timestamp_ntz, value double")


def states(df, alarm):
    return [r.state for r in alarms.evaluate(df, alarm).orderBy("window_start").collect()]


def test_consecutive_windows(spark):
    alarm = Alarm("a", "d", 300, 3, 10.0, "above")
    values = dict(enumerate([11.0, 12.0, 13.0, 10.0, 11.0, 11.0, 11.0, 11.0]))
    assert states(windows(spark, values), alarm) == ["OK", "OK", "ALARM", "OK", "OK", "OK", "ALARM", "ALARM"]


def test_a_gap_ends_a_run(spark):
    alarm = Alarm("a", "d", 300, 2, 10.0, "above")
    assert states(windows(spark, {0: 11.0, 1: 11.0, 3: 11.0, 4: 11.0}), alarm) == ["OK", "ALARM", "OK", "ALARM"]


def test_missing_data_breaches_only_if_told(spark):
    alarm = ALARMS["no_data"]
    df = alarms.with_empty_windows(windows(spark, {0: 3.0, 4: 1.0}), alarm)
    assert states(df, alarm) == ["OK", "OK", "ALARM", "ALARM", "OK"]
    longer = alarms.with_empty_windows(windows(spark, {0: 3.0}), alarm, end="2025-08-08 00:10:00")
    assert states(longer, alarm) == ["OK", "OK", "ALARM"]


def test_transitions(spark):
    alarm = Alarm("a", "d", 300, 1, 2000.0, "above")
    df = alarms.evaluate(windows(spark, {0: 1.0, 1: 2500.0, 2: 2600.0, 3: 5.0}), alarm)
    found = alarms.transitions(df, alarm).orderBy("state_change_time").collect()
    assert [(r.old_state, r.new_state) for r in found] == [("OK", "ALARM"), ("ALARM", "OK")]
    assert found[0].reason == (
        "Threshold Crossed: 1 out of the last 1 datapoints [2500.0 (08/08/25 00:05:00)]"
        " was greater than the threshold (2000.0)."
    )
    assert found[0].state_change_time == datetime(2025, 8, 8, 0, 10)


def test_alarms_by_dimension(spark):
    alarm = Alarm("a", "d", 300, 2, 10.0, "above")
    df = windows(spark, {0: 11.0, 1: 11.0, 2: 1.0}).crossJoin(spark.createDataFrame([("p",), ("q",)], "pool string"))
    df = df.where("not (pool = 'q' and value = 1.0)")
    full = alarms.with_empty_windows(df, alarm, ["pool"])
    assert full.count() == 5
    out = alarms.evaluate(full, alarm, ["pool"])
    assert alarms.transitions(out, alarm, ["pool"]).count() == 3


def test_quality(spark, lines, line):
    from logbasin.functions.patterns import LAYOUTS, Layout
    from logbasin.operators import parse

    df = lines(line, line.replace("Aug  8", "Aug 18"), "y" * 150)
    records = parse.parse_lines(df)
    assert quality.parse_validity(records).collect()[0].asDict() == {"total_lines": 3, "valid_lines": 2, "invalid_lines": 1}
    found = quality.invalid_lines(records, excerpt=100).collect()[0]
    assert found.excerpt == "y" * 100 + "..." and found.line.startswith("y" * 101)
    assert quality.group_count_check(df).collect()[0].complete == 2
    short = Layout(LAYOUTS["tolerant"].pattern, LAYOUTS["tolerant"].fields[:-1])
    assert quality.group_count_check(df, layout=short).collect()[0].partial == 2
    outcomes = {r.outcome: r.differences for r in quality.reconciled(df).collect()}
    assert outcomes == {
        "both": ["edad_cache", "campo_reservado_1"], "numbered_only": None, "neither": None}
    table = etl.requests(df)
    report = quality.schema_conformance(table, ["year", "month", "day", "hour"]).collect()[0]
    assert (report.status, report.schema_columns, report.partition_keys) == ("PASS", 33, 4)
    report = quality.schema_conformance(table.drop("is_mobile"), ["year"]).collect()[0]
    assert (report.status, report.missing_columns) == ("PARTIAL", ["is_mobile"])
    assert quality.table_conformance(spark, "no_such_table").collect()[0].status == "FAIL"
    raw = parse.raw_records(df).where("reject_reason is null").withColumn("codigo_respuesta", F.lit("x"))
    rows = {r.field: (r.missing, r.type_errors) for r in quality.field_completeness(raw).collect()}
    assert rows["codigo_respuesta"] == (2, 2) and rows["hostname"] == (0, 0)


def test_profile_ignores_zeros(spark):
    table = requests(spark, [(1, 200, 0, "p"), (2, 0, 7, "q"), (3, 404, 10, "")]).selectExpr(
        "*", "cast(null as string) as content_type", "'GET' as metodo", "cast(0 as bigint) as tamano_respuesta")
    row = quality.data_profile(table).collect()[0]
    assert (row.min_response_time, row.max_response_time, row.mean_response_time) == (7, 10, 8)
    assert (row.mean_response_size, row.response_codes, row.pools, row.content_types) == (None, 2, 2, 0)


def test_empty_input_gives_empty_or_null_reports(spark, lines):
    from logbasin.operators import parse

    table = etl.requests(lines("nothing to see"))
    span = (datetime(2025, 8, 1), datetime(2025, 8, 31))
    assert jobs.slow_rate(table, *span).collect()[0].slow_rate is None
    assert jobs.etl_error_stats(table).collect()[0].asDict() == {
        "total_records": 0, "error_records": 0, "slow_records": 0, "error_rate": None, "slow_rate": None}
    assert jobs.etl_format_stats(parse.parse_lines(lines())).collect()[0].success_rate is None
    assert quality.data_profile(table).collect()[0].records == 0
    assert jobs.error_analysis(table).count() == jobs.hourly_summary(table).count() == 0


def test_groups_without_any_time(spark):
    table = requests(spark, [(i, 500, None, "p") for i in range(12)]).selectExpr(
        "*", "cast(null as bigint) as tamano_respuesta", "'c' as ip_cliente_externo")
    row = jobs.pool_health_monitoring(table).collect()[0]
    assert (row.total_requests, row.avg_response_time_ms, row.p95_response_time_ms) == (12, None, None)


def test_distinct_rows_carry_no_measures(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id % 7 as v", "id % 11 as a", "id % 13 as b", "id as m")
    out = summarize(df, ["k"], "v", {"p": 50}, {"s": total(F.col("m")), "n": filled(F.col("m"))}, {"da": "a", "db": "b"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "sum(CASE WHEN (spark_grouping_id" in plan
    got = {r.k: (r.rows, r.s, r.n, r.da, r.db) for r in out.collect()}
    want = {k: (len(ids := range(k, 1000, 3)), sum(ids), len(ids), 11, 13) for k in range(3)}
    assert got == want
