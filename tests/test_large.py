"""What keeps disk and time in proportion on large inputs."""

from __future__ import annotations

import base64
import gzip
import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logbasin.functions import cleaning
from logbasin.operators import parse
from logbasin.plans import etl
from logbasin.session import new_folder
from logbasin.sources import fixtures, readers, writers
from logbasin.streaming import jobs as streams


def _files(folder: str) -> list[Path]:
    return [p for p in Path(folder).rglob("part-*")]


def test_published_messages_are_gzip_unless_told_otherwise(spark):
    folder = new_folder(spark, "sent")
    messages = spark.createDataFrame([("1", "x" * 1000)], "key string, value string")
    writers.publish(messages, path=f"{folder}/a")
    writers.publish(messages, path=f"{folder}/b", compression="none")
    assert {p.suffix for p in _files(f"{folder}/a")} == {".gz"} and {p.suffix for p in _files(f"{folder}/b")} == {".json"}
    assert spark.read.json(f"{folder}/a").count() == 1


def test_streamed_alerts_and_rejects_are_gzip(spark, lines, line):
    folder = new_folder(spark, "gz")
    lines(line, line.replace(" 200 ", " 500 "), "corrupt " + line).write.text(f"{folder}/raw")
    streams.filter_alerts(readers.stream_lines(spark, f"{folder}/raw"), f"{folder}/alerts", f"{folder}/s1", streams.AVAILABLE_NOW).awaitTermination()
    streams.ingest(readers.stream_lines(spark, f"{folder}/raw"), f"{folder}/table", f"{folder}/errors", f"{folder}/s2", streams.AVAILABLE_NOW).awaitTermination()
    assert {p.suffix for p in _files(f"{folder}/alerts") + _files(f"{folder}/errors")} == {".gz"}
    assert readers.read_requests(spark, f"{folder}/table").count() == 2 and readers.read_rejects(spark, f"{folder}/errors").count() == 1


def test_staged_records_keep_no_accepted_line_and_hours_one_file(spark, lines, line, monkeypatch):
    folder = new_folder(spark, "run")
    monkeypatch.setattr(etl, "new_folder", lambda s, label: f"{folder}/{label}")
    etl.run(lines(*[line] * 50, "corrupt " + line).repartition(4), f"{folder}/table", f"{folder}/errors", "1")
    staged = spark.read.parquet(f"{folder}/parsed")
    assert staged.groupBy("outcome").agg(F.count("line").alias("n")).where("n > 0").collect() == [("rejected", 1)]
    assert len(_files(f"{folder}/table")) == 1 and readers.read_requests(spark, f"{folder}/table").where("is_error is not null").count() == 50


def _lineitem(spark, folder, keys) -> str:
    rows = [(k, i, i % 9, i % 7 + 1, 900.5 + i, "RN"[i % 2], "OF"[i % 2]) for i, k in enumerate(keys)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_lines_by_time_are_all_lines_in_even_stretches(spark):
    # Rows without an order have no time; a third of the others has that of two seconds.
    folder = _lineitem(spark, new_folder(spark, "table"), [None] * 30 + [*range(600)] + [5] * 300 * 2)
    lines = fixtures.lines_by_time(spark, folder)
    whole = fixtures.raw_lines(spark, folder)
    assert sorted(lines.collect(), key=str) == sorted(whole.collect(), key=str)
    records = parse.accepted(parse.parse_lines(lines)).withColumn("part", F.spark_partition_id())
    spans = records.groupBy("part").agg(F.min("parsed_timestamp_syslog").alias("a"), F.max("parsed_timestamp_syslog").alias("b"), F.count("*").alias("n")).orderBy("a", "b").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:])) and max(x.n for x in spans) < 3 * 1230 / len(spans)


def test_stored_requests_shuffle_given_columns_only(spark, monkeypatch):
    folder, seen = _lineitem(spark, new_folder(spark, "table"), range(50)), []
    monkeypatch.setattr(entry.writers, "write_requests", lambda df, path, **options: seen.append((df, options)))
    entry._stored(spark, folder)
    (df, options), = seen
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Rebalance" not in plan and plan.count("RepartitionByExpression") == 1 and options == {"gather": False}
    # Derived columns stand above the sort, so no field is parsed again for them.
    assert "AS is_error" in plan.split("Sort [", 1)[0] and plan.count("Sort [") == 1


def test_landed_files_are_packed_in_the_order_of_lines():
    def greedy(rows, limit):
        held, rolls, out = {}, {}, {}
        for text, hour in rows:
            size = len((text or "").encode()) + 1
            total = held.get(hour, 0) + size
            if total > limit and hour in held:
                rolls[hour], total = rolls.get(hour, 0) + 1, size
            held[hour] = total
            out.setdefault((hour, rolls.get(hour, 0)), []).append(text or "")
        return [("\n".join(texts), hour) for (hour, _), texts in out.items()]

    rng = random.Random(3)
    for _ in range(300):
        limit, n = rng.randrange(1, 40), rng.randrange(40)
        rows = sorted([(rng.choice([None, "", "é", "abc", "x" * rng.randrange(30)]), rng.choice([None, "a", "b"])) for _ in range(n)], key=lambda r: r[1] or "")
        cuts = sorted(rng.randrange(n + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        schema = pa.schema([("value", pa.string()), ("_hour", pa.string())])
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in p], pa.string()), pa.array([h for _, h in p], pa.string())], schema=schema) for p in parts]
        found = [(r["value"], r["_hour"]) for b in streams._packed_by_bytes(limit)(iter(batches)) for r in b.to_pylist()]
        assert found == greedy(rows, limit)


def test_landing_makes_no_folder_for_a_file(spark, lines):
    folder = new_folder(spark, "land")
    lines(*["x" * 50] * 40).coalesce(1).write.text(f"{folder}/in")
    at = F.lit("2025-08-08 07:30:00").cast("timestamp")
    streams.land(readers.stream_lines(spark, f"{folder}/in"), f"{folder}/raw", f"{folder}/state", streams.AVAILABLE_NOW, 102, at).awaitTermination()
    # Names as they were written: the hour's folder was moved whole.
    assert len(_files(f"{folder}/raw")) == 20
    assert readers.read_landed(spark, f"{folder}/raw").count() == 40


def test_adjacent_objects_are_cut_where_they_meet(spark, lines):
    texts = ['{"a":"1"}{"b":"x}{y"}{}', '{"a":"x}{y"}', '{"a":1}{', "{}{}", "no }{ object", '{"a}{b']
    old = F.split("value", r"(?<=\})(?=\{)")
    several = F.startswith("value", F.lit("{")) & F.contains("value", F.lit("}{")) & parse.parsed_json(F.col("value")).isNull()
    expected = lines(*texts).select(F.explode(F.when(several, old).otherwise(F.array("value"))).alias("value"))
    assert sorted(r.value for r in parse.split_adjacent_objects(lines(*texts)).collect()) == sorted(r.value for r in expected.collect())


def test_strip_and_spread(spark, lines):
    texts = [" a ", "\ta\x0b", "a b", "", " ", "\r\n", "a\x0c"]
    assert [r[0] for r in lines(*texts).select(cleaning.strip(F.col("value"))).collect()] == [t.strip(cleaning.BLANKS) for t in texts]
    assert readers.spread(spark.range(100), 37).rdd.getNumPartitions() == 37


def test_payloads_are_decoded_once(spark):
    texts = parse.decode_payload(spark.createDataFrame([("eA==",), ("%%",)], "data string")).where("reject_reason is null").select("value")
    assert texts._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and texts.collect() == [("x",)]


def test_encoded_batch_is_read_once(spark, line, monkeypatch):
    folder, seen, bad = new_folder(spark, "once"), [], line.replace(" 200 ", " 500 ")
    sent = [base64.b64encode(x).decode() for x in (bad.encode(), gzip.compress(bad.encode()), b"\xff\xfe")] + ["%%"]
    spark.createDataFrame([(x,) for x in sent], "value string").write.text(f"{folder}/raw")
    decode = parse.decode_payload
    monkeypatch.setattr(parse, "decode_payload", lambda df, *a: seen.append(df) or decode(df, *a))
    plans = []
    union = type(spark.range(1)).unionByName
    monkeypatch.setattr(type(spark.range(1)), "unionByName", lambda self, other, *a, **b: plans.append(1) or union(self, other, *a, **b))
    streams.filter_alerts(
        readers.stream_from(spark, "text", path=f"{folder}/raw"), f"{folder}/alerts", f"{folder}/state", streams.AVAILABLE_NOW, rejects_path=f"{folder}/errors"
    ).awaitTermination()
    assert len(seen) == 1 and not plans
    assert [r.log_type for r in readers.read_alerts(spark, f"{folder}/alerts").collect()] == ["f5_access", "f5_access"]
    rejects = readers.read_rejects(spark, f"{folder}/errors").collect()
    assert sorted(r.line for r in rejects) == sorted(["%%", sent[2]]) and {(r.record_format, r.reject_reason) for r in rejects} == {(None, "undecodable")}
