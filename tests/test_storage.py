from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from logbasin.operators import alerts, enrich, parse
from logbasin.plans import etl
from logbasin.schema import table_schema
from logbasin.session import new_folder, shared_folder
from logbasin.sources import readers, retention, writers
from logbasin.streaming import jobs as streams
from logbasin.streaming.windows import WindowStore


def at(line, day, hour="03", **replace):
    text = line.replace("Aug  8 03", f"Aug {day:2d} {hour}").replace("08/Aug/2025:03", f"{day:02d}/Aug/2025:{hour}")
    for old, new in replace.items():
        text = text.replace(old, new)
    return text


@pytest.fixture
def table(spark, lines, line):
    return etl.requests(lines(*[at(line, d) for d in (1, 2, 3, 10, 20)]))


def days(df):
    return sorted(r.day for r in df.collect())


def test_roundtrip_and_schema(spark, table):
    path = new_folder(spark, "t")
    writers.write_requests(table, path)
    stored = readers.read_requests(spark, path)
    assert stored.schema == table_schema()
    drop = ["processing_timestamp"]
    assert sorted(map(str, stored.drop(*drop).collect())) == sorted(map(str, table.drop(*drop).collect()))


def test_overwrite_modes(spark, table):
    path = new_folder(spark, "t")
    writers.write_requests(table, path)
    writers.write_requests(table.where("day = 2"), path, mode="overwrite")
    assert days(readers.read_requests(spark, path)) == [1, 2, 3, 10, 20]
    writers.append_requests(table.where("day = 2"), path)
    assert days(readers.read_requests(spark, path)) == [1, 2, 2, 3, 10, 20]
    writers.write_requests(table.where("day = 2"), path, replace_all=True)
    assert days(readers.read_requests(spark, path)) == [2]


def test_rows_without_a_time_are_kept(spark, lines, line):
    path = new_folder(spark, "t")
    writers.write_requests(etl.requests(lines(line, line.replace("Aug  8 03", "Abc  8 03"))), path, gather=False)
    stored = readers.read_requests(spark, path)
    assert stored.count() == 2 and stored.where("day is null").count() == 1
    retention.expire(spark, path, date(2030, 1, 1))
    assert readers.read_requests(spark, path).count() == 1


def test_retention_keeps_the_cutoff_day(spark, table):
    path = new_folder(spark, "t")
    writers.write_requests(table, path)
    gone = retention.expire(spark, path, date(2025, 8, 30), keep_days=20)
    assert len(gone) == 3
    assert days(readers.read_requests(spark, path)) == [10, 20]


def test_a_hot_hour_is_written_by_many_tasks(spark):
    """A third and more of all rows in one hour: its rows come out as several files."""
    df = spark.range(60000).selectExpr(
        "2025 as year", "8 as month", "8 as day", "cast(if(id % 3 < 2, 3, id % 24) as int) as hour",
        "sha2(cast(id as string), 512) as body")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    path = new_folder(spark, "hot")
    try:
        writers.by_partition(df.repartition(8)).write.partitionBy("year", "month", "day", "hour").parquet(path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    files = spark.read.parquet(path).select("hour", F.input_file_name().alias("f")).distinct().groupBy("hour").count()
    counts = {r.hour: r["count"] for r in files.collect()}
    assert counts[3] > 3
    assert sum(n for h, n in counts.items() if h != 3) <= 3 * (len(counts) - 1)


def test_publication(spark):
    df = spark.range(25).selectExpr("id", "cast(id as string) as v")
    messages = writers.publication(df, "id").collect()
    assert {m.key for m in messages} == {str(i) for i in range(10)}
    assert json.loads(messages[0].value) == {"v": "0"}
    assert writers.publication(df, max_records=7).count() == 7


def test_envelopes_come_back(spark, lines, line):
    wrapped = enrich.ingest_envelope(lines(line))
    assert set(json.loads(wrapped.collect()[0].value)) == {"message", "log_type", "processed_at", "processed_by", "agent_version"}
    assert parse.accepted(parse.parse_lines(wrapped)).count() == 1


def test_gzip_and_nested_folders(spark, lines, line):
    path = new_folder(spark, "raw")
    lines(line).write.option("compression", "gzip").text(f"{path}/year=2025/month=08")
    lines(line).write.text(f"{path}/other")
    assert readers.read_lines(spark, path).count() == 2


def test_shared_folder_is_the_one_set(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def run(started):
    started.awaitTermination()


def test_incremental_runs_read_only_new_files(spark, lines, line):
    root = new_folder(spark, "inc")
    for day in (1, 10):
        lines(at(line, day), "z" * 80).write.mode("append").text(f"{root}/raw")
        source = readers.stream_lines(spark, f"{root}/raw", files_per_batch=100)
        run(streams.ingest(source, f"{root}/table", f"{root}/errors", f"{root}/state", streams.AVAILABLE_NOW))
    assert days(spark.read.parquet(f"{root}/table")) == [1, 10]
    errors = spark.read.json(f"{root}/errors")
    assert errors.count() == 2 and {r.reject_reason for r in errors.collect()} == {"unknown_format"}


def test_streamed_alerts_equal_the_batch(spark, lines, line):
    root = new_folder(spark, "alerts")
    df = lines(line, line.replace("Time 4213", "Time 9000"), "a FATAL thing")
    df.write.text(f"{root}/raw")
    run(streams.filter_alerts(readers.stream_lines(spark, f"{root}/raw"), f"{root}/alerts", f"{root}/state",
                              streams.AVAILABLE_NOW, f"{root}/metrics"))
    batch = alerts.alert_records(df)
    stored = spark.read.schema(batch.schema).json(f"{root}/alerts")
    assert sorted(r.original_log for r in stored.collect()) == sorted(r.original_log for r in batch.collect())
    assert spark.read.parquet(f"{root}/metrics").count() == 10


def test_landing_keeps_every_line(spark, lines, line):
    root = new_folder(spark, "landing")
    lines(line, "anything").write.text(f"{root}/in")
    run(streams.land(readers.stream_lines(spark, f"{root}/in"), f"{root}/raw", f"{root}/state", streams.AVAILABLE_NOW))
    assert sorted(r.value for r in readers.read_lines(spark, f"{root}/raw").collect()) == sorted([line, "anything"])


def test_encoded_payloads_are_filtered_and_the_bad_ones_kept(spark, lines, line):
    root = new_folder(spark, "encoded")
    df = lines(line, line.replace("Time 4213", "Time 9000"), "a FATAL thing")
    encoded = F.translate(F.base64(F.col("value").cast("binary")), "\r\n", "")
    df.select(encoded.alias("value")).union(lines("***")).write.text(f"{root}/raw")
    source = readers.stream_from(spark, "text", path=f"{root}/raw")
    with pytest.raises(ValueError):
        streams.filter_alerts(source, f"{root}/alerts", f"{root}/state")
    run(streams.filter_alerts(source, f"{root}/alerts", f"{root}/state", streams.AVAILABLE_NOW, rejects_path=f"{root}/errors"))
    batch = alerts.alert_records(df)
    stored = spark.read.schema(batch.schema).json(f"{root}/alerts")
    assert sorted(r.original_log for r in stored.collect()) == sorted(r.original_log for r in batch.collect())
    assert [(r.line, r.reject_reason) for r in spark.read.json(f"{root}/errors").collect()] == [("***", "undecodable")]
    run(streams.ingest(source, f"{root}/table", f"{root}/bad", f"{root}/state2", streams.AVAILABLE_NOW))
    assert spark.read.parquet(f"{root}/table").count() == 2 and spark.read.json(f"{root}/bad").count() == 2


def test_one_run_stores_both_outcomes_and_late_rows_erase_nothing(spark, lines, line):
    root = new_folder(spark, "run")
    first = etl.run(lines(at(line, 8), at(line, 9), "z" * 80), f"{root}/table", f"{root}/errors", "a")
    assert first == {"total_records": 3, "json_records": 0, "text_records": 2, "parsed_successfully": 2, "rejected": 1}
    etl.run(lines(at(line, 8).replace("Time 4213", "Time 5")), f"{root}/table", f"{root}/errors", "b")
    table = readers.read_requests(spark, f"{root}/table")
    assert sorted(r.day for r in table.collect()) == [8, 8, 9] or sorted(str(r.day) for r in table.collect()) == ["08", "08", "09"]
    # A repeated run replaces its own quarantine.
    etl.run(lines("y" * 80), f"{root}/table", f"{root}/errors", "a")
    assert [r.line for r in spark.read.json(f"{root}/errors").collect()] == ["y" * 80] and table.count() == 3
    assert etl.run(lines(), f"{root}/table", f"{root}/errors", "c")["total_records"] == 0


@pytest.mark.parametrize("zone", ["UTC", "America/Montevideo"])
def test_streamed_windows_equal_the_batch(spark, lines, line, zone):
    """All windows, those too that the watermark has not closed, in their newest state."""
    root = new_folder(spark, "windows")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = lines(*[at(line, 8, f"{h:02d}") for h in (1, 1, 2, 23)])
        df.write.text(f"{root}/raw")
        run(streams.window_metrics(readers.stream_lines(spark, f"{root}/raw"), f"{root}/out", f"{root}/state",
                                   streams.AVAILABLE_NOW))
        requests = alerts.all_requests(etl.requests(df), "parsed_timestamp_syslog")
        batch = alerts.windowed_pool_metrics(requests, "parsed_timestamp_syslog")
        stored = readers.read_window_metrics(spark, f"{root}/out").select(*batch.columns)
        assert sorted(map(str, stored.collect())) == sorted(map(str, batch.collect())) and stored.count() == 15
        # Another row of an open window: its state changes, the others stay.
        lines(at(line, 8, "23")).write.mode("append").text(f"{root}/raw")
        run(streams.window_metrics(readers.stream_lines(spark, f"{root}/raw"), f"{root}/out", f"{root}/state",
                                   streams.AVAILABLE_NOW))
        counts = readers.read_window_metrics(spark, f"{root}/out").where("metric = 'RequestCount'")
        assert sorted(r.value for r in counts.collect()) == [1, 2, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_backlog_of_several_batches_loses_no_late_rows(spark, lines, line):
    """The first file holds the latest time; the next ones go back by hours and overlap it."""
    root = new_folder(spark, "backlog")
    drops = [("01", "23"), ("01", "02", "23"), ("03", "01")]
    for hours in drops:
        lines(*[at(line, 8, h) for h in hours]).coalesce(1).write.mode("append").text(f"{root}/raw")
    source = readers.stream_lines(spark, f"{root}/raw", files_per_batch=1)
    run(streams.window_metrics(source, f"{root}/out", f"{root}/state", streams.AVAILABLE_NOW))
    counts = readers.read_window_metrics(spark, f"{root}/out").where("metric = 'RequestCount'")
    assert sorted(r.value for r in counts.collect()) == [1, 1, 2, 3]
    assert WindowStore(spark, f"{root}/out").table.live().select("number").distinct().count() == 3
