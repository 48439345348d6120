"""Committed tables, exact windows, alarms on streams, line numbers, landing by size, crawls and sketches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logbasin.functions.timestamps import as_instant
from logbasin.operators import alarms, alerts, parse, quality, sketches
from logbasin.operators.alarms import Alarm
from logbasin.plans import etl
from logbasin.schema import table_schema
from logbasin.session import new_folder
from logbasin.sources import catalog, readers, writers
from logbasin.sources.manifest import LOG, SNAPSHOT_EVERY, CommitConflict, CommittedTable
from logbasin.streaming import alarms as live
from logbasin.streaming import jobs as streams
from logbasin.streaming.windows import WindowStore

ROWS = "id long, k string"


def at(line, day, hour="03"):
    return line.replace("Aug  8 03", f"Aug {day:2d} {hour}").replace("08/Aug/2025:03", f"{day:02d}/Aug/2025:{hour}")


def run(started):
    started.awaitTermination()


def ids(table):
    return sorted(r.id for r in table.read(ROWS).collect())


@pytest.fixture
def table(spark):
    return CommittedTable(spark, new_folder(spark, "committed"), ["k"])


def rows(spark, *numbers):
    return spark.createDataFrame([(n, f"k{n % 2}") for n in numbers], ROWS)


# -- commits ----------------------------------------------------------------------------


def test_a_repeated_batch_adds_nothing(spark, table):
    assert not table.exists() and table.last("w") == -1 and ids(table) == []
    assert table.append(rows(spark, 1, 2), "w", 0)
    assert not table.append(rows(spark, 1, 2), "w", 0)
    assert table.append(rows(spark, 1), "other", 0)
    assert ids(table) == [1, 1, 2] and table.last("w") == 0 and table.exists()


def test_files_without_a_commit_do_not_count(spark, table, monkeypatch):
    table.append(rows(spark, 1), "w", 0)
    monkeypatch.setattr(table, "_commit", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.append(rows(spark, 3, 5), "w", 1)
    assert ids(table) == [1]
    monkeypatch.undo()
    table.append(rows(spark, 3), "w", 1)
    assert ids(table) == [1, 3]
    # Plain files below the table, as a failed writer leaves them, are cleared by age only.
    rows(spark, 9).write.mode("append").partitionBy("k").parquet(table.root)
    assert ids(table) == [1, 3] and table.vacuum() == 0
    # The two files of the try that was lost are among them.
    assert table.vacuum(-60) == 3 and ids(table) == [1, 3]


def test_partition_folders_hold_files_only(spark, table):
    for n in range(3):
        table.append(rows(spark, 1, 2), "w", n)
    found = table._fs.listStatus(table._path("k=k1"))
    assert len(found) == 3 and all(s.isFile() for s in found)


def test_snapshots_bound_the_log(spark, table):
    for n in range(3 * SNAPSHOT_EVERY + 2):
        table.append(rows(spark, n), "w", n)
    names = table._names(LOG)
    assert len([n for n in names if n.endswith(".json")]) < 2 * SNAPSHOT_EVERY and len([n for n in names if n.endswith(".snapshot")]) == 2
    assert ids(table) == list(range(3 * SNAPSHOT_EVERY + 2)) and table.last("w") == 3 * SNAPSHOT_EVERY + 1


def test_reads_select_files_by_partition(spark, table):
    table.append(rows(spark, 1, 2, 3, 4), "w", 0)
    assert sorted(r.id for r in table.read(ROWS, "k = 'k1'").collect()) == [1, 3]
    assert table.read(ROWS, "k = 'x'").count() == 0


def test_compaction_packs_and_readers_go_on(spark, table):
    for n in range(6):
        table.append(rows(spark, *range(n * 10, n * 10 + 10)).coalesce(1), "w", n)
    before = table.read(ROWS)
    sizes = {r.k: r.b for r in table.live().groupBy("k").agg(F.sum("bytes").alias("b")).collect()}
    target = max(sizes.values()) // 2
    assert table.compact(ROWS, target) == 12
    files = {r.k: r["count"] for r in table.live().groupBy("k").count().collect()}
    assert all(files[k] <= -(-sizes[k] // target) for k in files)
    assert ids(table) == list(range(60)) == sorted(r.id for r in before.collect())
    while table.compact(ROWS, target):
        pass
    assert table.vacuum(-60) >= 12 and ids(table) == list(range(60))


def test_two_compactions_of_the_same_files_conflict(spark, table):
    for n in range(2):
        table.append(rows(spark, n * 2), "w", n)
    paths = [r.path for r in table.live().collect()]
    table.compact(ROWS)
    with pytest.raises(CommitConflict):
        table.append(rows(spark, 0, 2), "late", 0, removed=paths)
    assert ids(table) == [0, 2]


def test_a_retried_stream_batch_is_stored_once(spark, lines, line):
    """The checkpoint is lost and the whole stream runs again over the same tables."""
    root = new_folder(spark, "retry")
    lines(at(line, 1), at(line, 2), "z" * 80).write.text(f"{root}/raw")
    for state in ("a", "b"):
        run(streams.ingest(readers.stream_lines(spark, f"{root}/raw"), f"{root}/table", f"{root}/errors", f"{root}/{state}", streams.AVAILABLE_NOW))
    stored = readers.read_requests(spark, f"{root}/table")
    assert stored.schema == table_schema() and sorted(r.day for r in stored.collect()) == [1, 2]
    assert [r.reject_reason for r in readers.read_rejects(spark, f"{root}/errors").collect()] == ["unknown_format"]
    assert readers.read_requests(spark, f"{root}/table", "day = 2").count() == 1


def test_hours_hold_no_batch_folders(spark, lines, line):
    root = new_folder(spark, "flat")
    for _ in range(3):
        lines(at(line, 1)).write.mode("append").text(f"{root}/raw")
        run(streams.ingest(readers.stream_lines(spark, f"{root}/raw"), f"{root}/t", f"{root}/e", f"{root}/s", streams.AVAILABLE_NOW))
    found = CommittedTable(spark, f"{root}/t")
    assert [s.isFile() for s in found._fs.listStatus(found._path("year=2025/month=8/day=1/hour=3"))] == [True] * 3
    assert found.compact(table_schema()) == 3 and readers.read_requests(spark, f"{root}/t").count() == 3


# -- windows ----------------------------------------------------------------------------


def requests(spark, seed, n):
    rng, start = random.Random(seed), datetime(2025, 8, 8)
    found = [
        (start + timedelta(seconds=rng.randrange(3 * 86400)), rng.choice(["A", "B"]), rng.choice(["p", "q", None]), "v", rng.choice([0, 7, 7, 5001, 9000]), rng.choice([200, 404, 500]))
        for _ in range(n)
    ]
    return spark.createDataFrame(found, "at timestamp_ntz, F5Environment string, Pool string, VirtualServer string, time_ms long, code int")


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (9, 3)])
def test_parts_of_windows_add_up_to_the_batch(spark, batches, fanout):
    path = new_folder(spark, "requests")
    requests(spark, 1, 400).write.parquet(path)
    whole = spark.read.parquet(path)
    store = WindowStore(spark, new_folder(spark, "windows"), fanout)
    for n, part in enumerate(whole.randomSplit([1.0] * batches, 3)):
        store.add(part, n, "at")
        store.add(part, n, "at")
    want = alerts.windowed_pool_metrics(whole, "at")
    assert sorted(map(str, store.metrics().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    levels = {r.level: r.n for r in store.table.live().groupBy("level").agg(F.count_distinct("number").alias("n")).collect()}
    assert all(n < fanout for n in levels.values())
    day = store.metrics("day = date'2025-08-09'").select("window_start").distinct().collect()
    assert day and all(r.window_start.day == 9 for r in day)


# -- alarms on a stream -----------------------------------------------------------------

SILENCE = Alarm("Silence", "Nothing comes", 60, 2, 1.0, "below", "breaching")
SLOW = Alarm("Slow", "Slow", 60, 3, 50.0, "above")


def changes(spark, root, drops, alarm, value, dimensions, time_type="timestamp"):
    """The drops one after the other, each in a run of its own on one checkpoint."""
    for drop in drops:
        drop.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(drop.schema).parquet(f"{root}/in").withColumn("at", as_instant(F.col("ts")))
        run(live.alarm_changes(source, "at", alarm, value, f"{root}/out", f"{root}/state", streams.AVAILABLE_NOW, dimensions, "1 minute"))
    return sorted(map(str, spark.read.parquet(f"{root}/out").collect()))


def events(spark, found):
    return spark.createDataFrame(found, "ts timestamp_ntz, pool string, ms long")


@pytest.mark.parametrize("dimensions", [[], ["pool"]])
def test_streamed_changes_equal_the_batch(spark, dimensions):
    rng, start = random.Random(4), datetime(2025, 8, 8, 23)
    found = [(start + timedelta(seconds=s), rng.choice("ab"), rng.choice([20, 90])) for s in range(0, 7200, 11) if s % 900 > 120]
    closing = [(start + timedelta(hours=9), p, 1) for p in "ab"]
    drops = [events(spark, found[:200]), events(spark, found[200:410]), events(spark, found[410:]), events(spark, closing)]
    whole = events(spark, found)
    windows = alarms.metric_windows(whole, "ts", SLOW, F.avg("ms"), dimensions)
    want = alarms.transitions(alarms.evaluate(windows, SLOW, dimensions), SLOW, dimensions)
    got = changes(spark, new_folder(spark, "slow"), drops, SLOW, F.avg("ms"), dimensions)
    assert got == sorted(map(str, want.collect())) and len(got) > 6


def test_silence_raises_the_alarm_without_a_row(spark):
    start = datetime(2025, 8, 8, 12)
    minutes = [0, 1, 2, 6, 7, 9, 30]
    found = [(start + timedelta(minutes=m, seconds=5), "a", 1) for m in minutes]
    # The clock of the stream goes on by rows of another pool.
    clock = [(start + timedelta(minutes=m), "b", 1) for m in (12, 25, 40, 60)]
    drops = [events(spark, found[:5]), events(spark, found[5:6] + clock[:1]), events(spark, clock[1:2]), events(spark, found[6:] + clock[2:3]), events(spark, clock[3:])]
    got = changes(spark, new_folder(spark, "silence"), drops, SILENCE, F.count(F.lit(1)), ["pool"])
    # The last window judged ends one minute (the delay) before the stream's clock.
    windows = alarms.with_empty_windows(
        alarms.metric_windows(events(spark, found + clock[:3]), "ts", SILENCE, F.count(F.lit(1)), ["pool"]), SILENCE, ["pool"], end="2025-08-08 12:58:00"
    )
    want = alarms.transitions(alarms.evaluate(windows, SILENCE, ["pool"]), SILENCE, ["pool"])
    assert got == sorted(map(str, want.collect()))
    assert any("no data" in text and "pool='a'" in text for text in got)


def test_windows_are_judged_across_midnight(spark):
    start = datetime(2025, 8, 8, 23, 55)
    found = [(start + timedelta(minutes=m), "a", 90 if m in (3, 4, 5, 6) else 10) for m in range(10)]
    windows = alarms.metric_windows(events(spark, found), "ts", SLOW, F.avg("ms"))
    states = {r.window_start.strftime("%H:%M"): r.state for r in alarms.evaluate(windows, SLOW).collect()}
    assert [t for t, s in sorted(states.items()) if s == "ALARM"] == ["00:00", "00:01"] and len(states) == 10
    found = alarms.transitions(alarms.evaluate(windows, SLOW), SLOW).orderBy("state_change_time").collect()
    assert [(r.old_state, r.new_state) for r in found] == [("OK", "ALARM"), ("ALARM", "OK")]


# -- line numbers, lag, landing ---------------------------------------------------------


@pytest.mark.parametrize("split", ["64b", "1k", "128m"])
def test_line_numbers_do_not_depend_on_splits(spark, lines, split):
    root = new_folder(spark, "numbers")
    texts = [f"line {i} " + "x" * (i % 37) if i % 11 else "" for i in range(500)]
    lines(*texts).coalesce(1).write.text(f"{root}/a")
    lines(*texts[:40]).coalesce(1).write.option("compression", "gzip").text(f"{root}/b")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = sorted((r.file.rpartition("/")[0][-1], r.line_number, r.value) for r in readers.numbered_lines(spark, root).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == [("a", i + 1, t) for i, t in enumerate(texts)] + [("b", i + 1, t) for i, t in enumerate(texts[:40])]


def test_bad_lines_carry_file_and_number(spark, lines, line):
    root = new_folder(spark, "bad")
    lines(line, "y" * 120, line, "z" * 60).coalesce(1).write.text(root)
    found = quality.invalid_lines(parse.parse_lines(readers.numbered_lines(spark, root)), excerpt=100).orderBy("line_number").collect()
    assert [(r.line_number, r.line, r.excerpt) for r in found] == [(2, "y" * 120, "y" * 100 + "..."), (4, "z" * 60, "z" * 60)]
    assert found[0].file.endswith(".txt")


def test_lag_is_taken_from_arrival(spark):
    alarm = alarms.ALARMS["lag"]
    records = spark.createDataFrame(
        [("f1", datetime(2025, 8, 8, 1, 0), datetime(2025, 8, 8, 0, 50)), ("f1", datetime(2025, 8, 8, 1, 0), datetime(2025, 8, 8, 0, 58)),
         ("f2", datetime(2025, 8, 8, 1, 2), datetime(2025, 8, 8, 1, 1)), ("f3", datetime(2025, 8, 8, 1, 9), None)],
        "file string, arrived timestamp, ts timestamp_ntz")
    found = alarms.arrival_lag(records, "ts", alarm).collect()
    assert [(r.window_start, r.value) for r in found] == [(datetime(2025, 8, 8, 1, 0), 120_000.0)]


def test_landed_files_end_at_the_limit(spark, lines):
    root = new_folder(spark, "roll")
    texts = [f"{i:03d}" + "x" * (i % 50) for i in range(300)] + ["long " * 100, "é" * 90, ""]
    lines(*texts).coalesce(2).write.text(f"{root}/in")
    run(streams.land(readers.stream_lines(spark, f"{root}/in"), f"{root}/raw", f"{root}/state", streams.AVAILABLE_NOW, 200, F.lit("2025-08-08 07:30:00").cast("timestamp")))
    landed = readers.read_landed(spark, f"{root}/raw")
    assert sorted(r.value for r in landed.collect()) == sorted(texts)
    assert {(r.year, r.month, r.day, r.hour) for r in landed.collect()} == {(2025, 8, 8, 7)}
    files = landed.groupBy("_metadata.file_path").agg(F.sum(F.octet_length("value") + 1).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(f.b <= 200 or f.n == 1 for f in files) and len(files) > 20
    assert readers.read_landed(spark, f"{root}/raw", "hour = 8").count() == 0


# -- catalog ----------------------------------------------------------------------------


def test_a_crawl_opens_only_new_folders_and_widens(spark, monkeypatch):
    root, name = new_folder(spark, "crawl"), "crawled_" + new_folder(spark, "x")[-8:]
    opened = []
    monkeypatch.setattr(catalog, "_footers", lambda s, folders, real=catalog._footers: opened.append(len(folders)) or real(s, folders))

    def add(day, columns):
        spark.range(2).selectExpr(*columns, "2025 as year", "8 as month", f"{day} as day", "3 as hour").coalesce(1).write.mode("append").partitionBy("year", "month", "day", "hour").parquet(root)

    keys = ["year", "month", "day", "hour"]
    add(1, ["cast(id as int) as a"])
    add(2, ["cast(id as int) as a"])
    assert catalog.crawl(spark, name, root).partitions == 2
    spark.sql(f"alter table {name} set tblproperties ('{catalog.LAST_RUN}' = '99999999999999')")
    assert catalog.crawl(spark, name, root) == catalog.Crawl()
    add(3, ["id as a", "'t' as b"])
    found = catalog.crawl(spark, name, root)
    assert (found.partitions, found.added, found.widened) == (1, ["b"], ["a"]) and opened == [2, 1]
    assert dict(spark.table(name).dtypes)["a"] == "bigint"
    assert sorted((r.day, r.a, r.b) for r in spark.table(name).collect() if r.day > 1) == [(2, 0, None), (2, 1, None), (3, 0, "t"), (3, 1, "t")]
    # A folder that has gone stays in the catalog.
    jvm = spark.sparkContext._jvm
    gone = jvm.org.apache.hadoop.fs.Path(f"{root}/year=2025/month=8/day=1")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    catalog.crawl(spark, name, root)
    assert spark.sql(f"show partitions {name}").count() == 3
    add(4, ["'text' as a"])
    with pytest.raises(catalog.SchemaConflict):
        catalog.crawl(spark, name, root, keys)


@pytest.mark.parametrize("a,b,c", [
    ("int", "bigint", "bigint"), ("tinyint", "int", "int"), ("float", "int", "double"), ("date", "timestamp_ntz", "timestamp_ntz"),
    ("decimal(5,2)", "decimal(7,1)", "decimal(8,2)"), ("string", "string", "string"), ("bigint", "double", None), ("string", "int", None),
])
def test_widening(a, b, c):
    kind = lambda t: T.StructType.fromDDL(f"x {t}")["x"].dataType
    for left, right in ((a, b), (b, a)):
        if c is None:
            with pytest.raises(catalog.SchemaConflict):
                catalog.wider(kind(left), kind(right))
        else:
            assert catalog.wider(kind(left), kind(right)) == kind(c)


# -- sketches ---------------------------------------------------------------------------


def test_sketches_unite_over_hours(spark):
    table = spark.range(40_000).selectExpr(
        "2025 as year", "8 as month", "8 as day", "cast(id % 24 as int) as hour", "concat('p', id % 2) as pool",
        "concat('c', id % 3001) as ip_cliente_externo", "if(id % 100 = 0, null, id) as tiempo_respuesta_ms")
    hourly = sketches.hourly(table, ["pool"])
    assert hourly.count() == 24
    path = new_folder(spark, "sketches")
    hourly.write.parquet(path)
    found = {r.pool: r for r in sketches.united(spark.read.parquet(path), ["pool"]).collect()}
    for r in found.values():
        assert r.records == 20_000 and abs(r.distinct_values - 3001) < 0.03 * 3001
        for p, q in ((50, r.p50), (95, r.p95), (99, r.p99)):
            assert abs(q / 40_000 - p / 100) < 0.015
    none = sketches.hourly(table.where("hour = 25"), ["pool"])
    assert sketches.united(none, ["pool"]).count() == 0
    nulls = sketches.united(sketches.hourly(table.selectExpr("* except (tiempo_respuesta_ms)", "cast(null as bigint) as tiempo_respuesta_ms"), ["pool"]), ["pool"])
    assert nulls.first().p95 is None


def test_writers_and_etl_still_share_the_table(spark, lines, line):
    """A table without commits is read as before."""
    path = new_folder(spark, "plain")
    writers.write_requests(etl.requests(lines(at(line, 1), at(line, 2))), path)
    assert readers.read_requests(spark, path).count() == 2 and readers.read_requests(spark, path, "day = 2").count() == 1
