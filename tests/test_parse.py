from __future__ import annotations

import base64
import gzip
import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logbasin.functions import patterns, timestamps
from logbasin.operators import parse
from logbasin.plans import etl, jobs
from logbasin.schema import FIELDS, OTHER_NAMES, json_record_schema
from logbasin.sources import fixtures

GARBAGE = "x" * 60


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def as_json(line_fields, old=False, **changes):
    record = {(OTHER_NAMES.get(k, k) if old else k): v for k, v in line_fields.items()}
    record.update(changes)
    return json.dumps(record)


@pytest.fixture
def fields(spark, lines, line):
    row = one(parse.raw_records(lines(line)).select(*FIELDS))
    return row.asDict()


def test_every_field_of_a_line(spark, lines, line):
    row = one(parse.accepted(parse.parse_lines(lines(line))))
    assert row.timestamp_syslog == "Aug  8 03:33:33"
    assert row.ip_red_interna == "10.233.1.14"
    assert row.usuario_autenticado is None and row.identidad is None and row.referer is None
    assert row.edad_cache == "" and row.campo_reservado_1 == "" and row.campo_reservado_2 is None
    assert (row.codigo_respuesta, row.tamano_respuesta, row.tiempo_respuesta_ms) == (200, 905, 4213)
    assert row.entorno_nodo == "TEPROD"
    assert row.parsed_timestamp_syslog == row.parsed_timestamp_apache == datetime(2025, 8, 8, 3, 33, 33)
    assert (row.year, row.month, row.day, row.hour) == (2025, 8, 8, 3)


def test_text_after_the_last_field_is_allowed(lines, line):
    assert one(parse.accepted(parse.parse_lines(lines(line + " and more")))).entorno_nodo == "TEPROD"


def test_one_pass_equals_extraction_by_field(spark, lines, line):
    df = lines(line, line.replace("Aug  8", "Aug 18"), GARBAGE, line + "\x01", line.replace('"GET', '"GET POST'))
    layout = patterns.LAYOUTS["tolerant"]
    for row in df.select(
        F.col("value"),
        patterns.captured(F.col("value"), layout).alias("a"),
        patterns.captured_by_field(F.col("value"), layout).alias("b"),
    ).collect():
        assert row.a == (None if "\x01" in row.value else row.b)


@pytest.mark.parametrize("layout, spaces, matches", [
    ("tolerant", 1, True), ("tolerant", 3, True), ("strict", 2, True), ("strict", 1, False),
])
def test_blanks_before_the_day(lines, line, layout, spaces, matches):
    text = line.replace("Aug  8", "Aug" + " " * spaces + "8")
    found = parse.accepted(parse.parse_lines(lines(text), layout=layout)).count()
    assert found == int(matches)


def test_two_digit_days_never_match_the_strict_layout(lines, line):
    assert parse.accepted(parse.parse_lines(lines(line.replace("Aug  8", "Aug 18")), layout="strict")).count() == 0


@pytest.mark.parametrize("name", ["tolerant", "strict", "unquoted", "grok"])
def test_layouts_have_one_group_per_field(name):
    layout = patterns.LAYOUTS[name]
    assert layout.groups == len(layout.fields) == 22
    assert sorted(layout.fields) == sorted(FIELDS)


def test_unicode_method(lines, line):
    text = line.replace('"GET', '"GÉT')
    assert parse.accepted(parse.parse_lines(lines(text))).count() == 0
    assert parse.accepted(parse.parse_lines(lines(text), unicode_classes=True)).count() == 1


@pytest.mark.parametrize("text, kind", [
    ("", "unknown"), ("   ", "unknown"), ('{"a": 1}', "json"), (' {"a": 1} ', "json"), ('{"a": 1', "unknown"),
    ("{'a': 1}", "unknown"), ('{"a": 1} {"a": 2}', "unknown"), ('{"a":1},{"a":2}', "unknown"),
    ('{"a":1}] x }', "unknown"), ('{"a": "}{"}', "json"), ("Aug  8 03:33:33 x", "text"), ("Aug 18 03:33:33", "text"),
    ("August 8 03:33:33", "unknown"), ("x Aug  8 03:33:33", "unknown"), ("{}", "json"),
])
def test_detect_format(lines, text, kind):
    assert one(lines(text).select(parse.detect_format(F.col("value")).alias("f"))).f == kind


def test_reject_reasons(lines, line, fields):
    no_key = {k: v for k, v in fields.items() if k != "hostname"}
    texts = {
        "short": "too_short",
        GARBAGE: "unknown_format",
        "Aug  8 03:33:33 " + GARBAGE: "no_pattern_match",
        as_json(no_key): "missing_keys",
        as_json(fields, hostname=None): None,
        as_json(fields): None,
        line: None,
    }
    found = {r.line: r.reject_reason for r in parse.parse_lines(lines(*texts)).collect()}
    assert found == {k.strip(): v for k, v in texts.items()}


def test_both_json_vocabularies_equal_the_text(spark, lines, line, fields):
    old = as_json(fields, old=True, codigo_respuesta=200, tamano_respuesta=905, tiempo_respuesta_ms=4213)
    rows = [
        one(parse.accepted(parse.parse_lines(lines(t)))) for t in (line, as_json(fields), old, json.dumps({"message": line}))
    ]
    assert all(r == rows[0] for r in rows)


def test_json_numbers_that_are_not_numbers_become_null(lines, fields):
    row = one(parse.accepted(parse.parse_lines(lines(as_json(fields, codigo_respuesta="abc", tamano_respuesta="99999999999")))))
    assert row.codigo_respuesta is None and row.tamano_respuesta == 99999999999


def test_envelopes_stay_json_unless_unwrapped(lines, line):
    row = one(parse.parse_lines(lines(json.dumps({"message": line})), unwrap=False))
    assert (row.record_format, row.reject_reason) == ("json", "missing_keys")


def test_envelope_with_several_lines(lines, line, fields):
    wrapped = json.dumps({"message": f"{line}\n\n  {line}  \n" + as_json(fields)})
    assert parse.accepted(parse.parse_lines(lines(wrapped))).count() == 3
    assert parse.unwrap_envelope(lines(wrapped, line)).count() == 4


def test_adjacent_objects(lines, fields):
    both = as_json(fields) + as_json(fields, old=True)
    tricky = as_json(fields, user_agent="a}{b")
    assert parse.accepted(parse.parse_lines(parse.split_adjacent_objects(lines(both, tricky)))).count() == 3


@pytest.mark.parametrize("rules, field, raw, clean", [
    ("main", "referer", "-", None), ("main", "referer", "", ""), ("main", "referer", '""', None),
    ("main", "referer", '"x"', "x"), ("main", "usuario_autenticado", '"bob"', '"bob"'),
    ("main", "usuario_autenticado", "-", None), ("main", "campo_reservado_2", '""', '""'),
    ("legacy", "referer", "", None), ("legacy", "usuario_autenticado", '"bob"', "bob"),
    ("legacy", "ambiente_pool", "-", "-"), ("checker", "user_agent", "-", "-"), ("checker", "edad_cache", "", None),
    ("main", "referer", '"', ""),
])
def test_null_cleaning(spark, rules, field, raw, clean):
    from logbasin.functions.cleaning import clean as expression

    df = spark.createDataFrame([(raw,)], f"{field} string").select(expression(field, F.col(field), rules).alias("x"))
    assert one(df).x == clean


@pytest.mark.parametrize("rules, expected", [
    ("main", (None, None, None)), ("legacy", (None, 0, None)), ("checker", (0, 0, 0)),
])
def test_bad_numbers(spark, rules, expected):
    from logbasin.functions.cleaning import clean as expression

    names = ["codigo_respuesta", "tamano_respuesta", "tiempo_respuesta_ms"]
    df = spark.createDataFrame([("x", "", None)], ", ".join(f"{n} string" for n in names))
    assert tuple(one(df.select(*[expression(n, F.col(n), rules).alias(n) for n in names]))) == expected


@pytest.mark.parametrize("text, request_text, base, expected", [
    ("Aug  8 03:33:33", None, 2024, datetime(2024, 8, 8, 3, 33, 33)),
    ("Aug 18 23:59:59", "18/Aug/2023:23:59:59 -0300", None, datetime(2023, 8, 18, 23, 59, 59)),
    ("Feb 29 00:00:00", None, 2024, datetime(2024, 2, 29)),
    ("Feb 29 00:00:00", None, 2025, None),
    ("Dec 31 23:59:59", "01/Jan/2026:00:00:01 -0300", None, datetime(2025, 12, 31, 23, 59, 59)),
    ("Jan  1 00:00:00", "31/Dec/2025:23:59:59 -0300", None, datetime(2026, 1, 1)),
    ("Xyz  8 03:33:33", None, 2024, None),
    ("Aug  8 25:00:00", None, 2024, None),
    ("nothing", None, 2024, None),
])
@pytest.mark.parametrize("zone", ["UTC", "America/Montevideo"])
def test_syslog_time(spark, text, request_text, base, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(text, request_text)], "a string, b string")
        value = timestamps.syslog_time(F.col("a"), base, F.col("b") if request_text else None)
        assert one(df.select(value.alias("t"))).t == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text, expected, epoch", [
    ("08/Aug/2025:03:33:33 -0300", datetime(2025, 8, 8, 3, 33, 33), 1754634813),
    ("8/aug/2025:03:33:33 +0000", datetime(2025, 8, 8, 3, 33, 33), 1754624013),
    ("31/Feb/2025:03:33:33 -0300", None, None),
    ("-", None, None),
])
def test_request_time(spark, text, expected, epoch):
    df = spark.createDataFrame([(text,)], "a string").select(
        timestamps.request_time(F.col("a")).alias("t"), F.unix_seconds(timestamps.request_instant(F.col("a"))).alias("e")
    )
    assert tuple(one(df)) == (expected, epoch)


def test_unparsed_syslog_time_keeps_the_record(lines, line):
    row = one(parse.accepted(parse.parse_lines(lines(line.replace("Aug  8 03", "Abc  8 03")))))
    assert row.parsed_timestamp_syslog is None and row.year is None and row.codigo_respuesta == 200


def test_pick_line_and_input_shape(spark, line):
    df = spark.createDataFrame([("short", 7, f"\t{line} "), (GARBAGE, 8, line)], "a string, n int, b string")
    assert [r.value for r in parse.pick_line(df).collect()] == [line, GARBAGE]
    assert parse.input_shape(df) == "a"
    assert parse.input_shape(df.withColumnRenamed("b", "log")) == "log"
    assert parse.input_shape(df.withColumnRenamed("b", "message").withColumnRenamed("a", "log")) == "message"
    schema = spark.createDataFrame([], json_record_schema())
    assert parse.input_shape(schema) == "preparsed"
    with pytest.raises(ValueError):
        parse.input_shape(df.select("n"))


def test_positional_names(lines, line):
    names = FIELDS + ["campo_reservado_3"]
    row = one(parse.positional_records(lines(line, GARBAGE), names=names))
    assert row.codigo_respuesta == "200" and row.campo_reservado_3 is None
    assert row.identidad is None and row.edad_cache == ""


def test_payloads(spark, line):
    def encode(data):
        return base64.b64encode(data).decode()

    text = line.encode()
    sent = [encode(text), encode(gzip.compress(text)), "%%%", encode(b"\x1f\x8bbroken"), encode(b"\xff\xfe\xfa"), None]
    df = spark.createDataFrame([(s,) for s in sent], "data string")
    found = parse.decode_payload(df).collect()
    assert [r.value for r in found] == [line, line, None, None, None, None]
    assert [r.data for r in found] == sent and [r.reject_reason for r in found] == [None, None] + ["undecodable"] * 4


def test_every_line_is_accounted_for(lines, line):
    sent = ['{"message": ""}', '{"message": " \\n "}', '{"a": "no access record, but long enough to be one"}', "short", "x" * 60, line]
    found = [r.reject_reason for r in parse.parse_lines(lines(*sent)).collect()]
    assert found == ["empty_message", "empty_message", "missing_keys", "too_short", "unknown_format", None]
    assert parse.unwrap_envelope(lines(*sent)).count() == len(sent)


def test_very_long_fields(lines, line):
    long = "a" * 100_000
    text = line.replace('"-"', f'"{long}"').replace("Mozilla/5.0", f"Mozilla/5.0 {long}")
    for layout in ("tolerant", "grok"):
        row = parse.parse_lines(lines(text), layout=layout).first()
        assert row.reject_reason is None and row.referer == long and long in row.user_agent


def test_legacy_pipeline_accepts_all_shapes(spark, line, fields):
    by_shape = [
        spark.createDataFrame([(line,)], "message string"),
        spark.createDataFrame([(line,)], "log string"),
        spark.createDataFrame([(1, line)], "n int, anything string"),
        spark.createDataFrame([{OTHER_NAMES.get(k, k): v for k, v in fields.items()}], ", ".join(
            f"{OTHER_NAMES.get(k, k)} string" for k in fields)),
    ]
    for df in by_shape:
        row = one(etl.legacy_requests(df))
        assert (row.f5_bigip_name, row.status_category, row.response_time_category) == ("TEPROD", "Success", "Normal")
        assert row.parsed_timestamp_rp == datetime(2025, 8, 8, 3, 33, 33) and row.hour == 3
    assert row.raw_log == "Aug  8 03:33:33 www.example.org 10.1.2.1 GET /org-1/files/7.js?v=1 HTTP/1.1 200 905"


def test_counts_while_writing(spark, lines, line):
    from pyspark.sql import Observation

    records = parse.parse_lines(lines(line, GARBAGE))
    seen = Observation("seen")
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 2
    assert etl.observed(records).columns == records.columns
    stats = one(jobs.etl_format_stats(records))
    assert (stats.total_records, stats.text_records, stats.parsed_successfully, stats.success_rate) == (2, 1, 1, 50.0)


TOKEN = st.text("abcdefgXYZ0189.:-_/", min_size=1, max_size=12)
QUOTED = st.text("abc XYZ/;().=-ñ", max_size=20)


@settings(max_examples=15, deadline=None)
@given(st.lists(
    st.tuples(TOKEN, TOKEN, QUOTED, QUOTED, st.integers(0, 10**12), st.integers(0, 999), st.sampled_from(["-", '"u"'])),
    min_size=1, max_size=20,
))
def test_rendered_fields_come_back(spark, samples):
    columns = {
        "timestamp_syslog": "Aug  8 03:33:33", "identidad": '""', "timestamp_apache": "08/Aug/2025:03:33:33 -0300",
        "metodo": "GET", "protocolo": "HTTP/1.0", "edad_cache": "1", "content_type": "a/b", "campo_reservado_1": "",
        "campo_reservado_2": "-", "ambiente_origen": "o", "ambiente_pool": "p", "entorno_nodo": "N_1",
        "ip_red_interna": "::1",
    }
    rows = [
        {**columns, "hostname": h, "ip_cliente_externo": i, "recurso": "/" + a, "referer": a, "user_agent": b,
         "tamano_respuesta": str(size), "codigo_respuesta": str(code), "tiempo_respuesta_ms": str(size), "usuario_autenticado": u}
        for h, i, a, b, size, code, u in samples
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in FIELDS))
    back = parse.raw_records(df.select(fixtures.text_line().alias("value")))
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted((r.asDict() for r in back.select(*FIELDS).collect()), key=key) == sorted(rows, key=key)
