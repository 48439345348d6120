"""Access-log lines derived from the ``lineitem`` table.

The given tables hold no access logs. This projection turns every row of
``lineitem`` into one log record, rendered as plain text, JSON in either
vocabulary, a JSON envelope or a corrupt line, so that all parsing runs over
the whole table.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logbasin.functions import classify
from logbasin.functions.classify import PROFILES
from logbasin.schema import FIELDS, OTHER_NAMES
from logbasin.sources import readers

# The second of August in which a record arrives.
SECOND = "(l_orderkey * 7919 + l_linenumber * 104729) % 2678400"

PROJECTION = [
    "case when l_orderkey % 50 = 7 then 'bad' when l_orderkey % 10 in (0, 1) then 'json'"
    " when l_orderkey % 10 = 2 then 'json_old' when l_orderkey % 10 = 3 then 'envelope' else 'text' end as fmt",
    f"{SECOND} as sec",
    "concat('10.', cast(l_suppkey % 8 as string), '.', cast(l_partkey % 250 as string), '.1') as ip_cliente_externo",
    "concat('10.233.', cast(l_linenumber as string), '.14') as ip_red_interna",
    "case when l_orderkey % 97 = 0 then 'PROPFIND' when l_linenumber = 5 then 'HEAD' else 'GET' end as metodo",
    "concat('/org-', cast(l_suppkey % 20 as string), '/files/', cast(l_partkey as string),"
    " case l_partkey % 4 when 0 then '.js?v=1' when 1 then '.css' when 2 then '.png' else '' end) as recurso",
    "case (l_partkey + l_linenumber) % 20 when 0 then 404 when 1 then 403 when 2 then 500 when 3 then 301"
    " when 4 then 302 when 5 then 304 when 6 then 503 else 200 end as codigo_respuesta",
    "cast(floor(l_extendedprice * case when l_linenumber = 1 then 400 else 1 end) as bigint) as tamano_respuesta",
    "case when l_returnflag = 'R' then '-' else 'https://www.example.org/' end as referer",
    "case l_orderkey % 4 when 0 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 18_5) Mobile/15E148'"
    " when 1 then 'Mozilla/5.0 (Linux; Android 14)' when 2 then '' else 'Mozilla/5.0 (Windows NT 10.0)' end"
    " as user_agent",
    "(cast(floor(l_extendedprice) as bigint) * l_linenumber) % 9000 as tiempo_respuesta_ms",
    "case l_partkey % 3 when 0 then '' when 1 then '-' else '120' end as edad_cache",
    "case l_partkey % 9 when 0 then 'application/javascript' when 1 then 'text/css' when 2 then 'image/png'"
    " when 3 then 'text/html' when 4 then 'application/json' when 5 then 'font/woff2'"
    " when 6 then 'application/pdf' when 7 then '-' else '' end as content_type",
    "concat('/Portal/vs-', case when l_linestatus = 'O' then 'TEPROD' else 'PAPROD' end) as ambiente_origen",
    "concat('/Portal/Pool_', cast(l_suppkey % 20 as string)) as ambiente_pool",
    "case when l_linestatus = 'O' then 'TEPROD' else 'PAPROD' end as entorno_nodo",
]

# The columns the projection reads.
COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus",
]

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


# A row becomes a record some thirty times as large, so a task gets fewer bytes than Spark would give it: what it makes of
# them should not spill.
SPLIT_BYTES = 8 << 20


# Rows that are stored as they are rendered and parsed are also sorted by the hour, as wide as they are then.
STRETCH_BYTES = 4 << 20


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS)


def lineitem_bytes(spark: SparkSession, sf_dir: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(lineitem_rows(spark, sf_dir), -(-lineitem_bytes(spark, sf_dir) // SPLIT_BYTES))


def stretches(spark: SparkSession, sf_dir: str) -> int:
    """How many stretches of time the lines are dealt into."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-lineitem_bytes(spark, sf_dir) // STRETCH_BYTES))


def field_values(rows: DataFrame, *keep: str) -> DataFrame:
    """The raw field values of every record, as they stand in a line, its ``fmt`` and the columns to keep."""
    values = rows.selectExpr(*keep, *PROJECTION)
    time = F.expr("timestamp_ntz'2025-08-01 00:00:00' + make_dt_interval(0, 0, 0, sec)")
    values = values.withColumn("time", time)
    clock = F.substring(F.col("time").cast("string"), 12, 8)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("time"))
    day = F.dayofmonth("time").cast("string")
    return values.select(
        *keep,
        "fmt",
        "time",
        F.concat_ws(" ", month, F.lpad(day, 2, " "), clock).alias("timestamp_syslog"),
        F.lit("www.example.org").alias("hostname"),
        "ip_cliente_externo",
        "ip_red_interna",
        F.lit("-").alias("usuario_autenticado"),
        F.lit('""').alias("identidad"),
        F.concat(
            F.lpad(day, 2, "0"), F.lit("/"), month, F.lit("/"), F.year("time").cast("string"),
            F.lit(":"), clock, F.lit(" -0300"),
        ).alias("timestamp_apache"),
        "metodo",
        "recurso",
        F.lit("HTTP/1.1").alias("protocolo"),
        "codigo_respuesta",
        "tamano_respuesta",
        "referer",
        "user_agent",
        "tiempo_respuesta_ms",
        "edad_cache",
        "content_type",
        F.lit("").alias("campo_reservado_1"),
        F.lit("-").alias("campo_reservado_2"),
        "ambiente_origen",
        "ambiente_pool",
        "entorno_nodo",
    )


# The text around the fields of a line.
QUOTED = '%s %s %s [%s] %s %s [%s] "%s %s %s" %s %s "%s" "%s" Time %s Age "%s" "%s" "%s" %s "%s" "%s" %s'
UNQUOTED = '%s %s %s %s %s %s [%s] "%s %s %s" %s %s "%s" "%s" %s %s "%s" %s %s %s %s %s'


def _filled(template: str, values: list[str]) -> Column:
    """The template with its gaps filled, as one concatenation."""
    pieces = template.split("%s")
    parts = [f"'{pieces[0]}'"]
    for value, text in zip(values, pieces[1:]):
        parts += [f"cast({value} as string)", f"'{text}'"]
    return F.expr(f"concat({', '.join(parts)})")


def text_line() -> Column:
    """The plain line of a record."""
    return _filled(QUOTED, FIELDS)


def json_line() -> Column:
    """As an agent writes it: canonical names, all strings."""
    return F.expr("to_json(struct(" + ", ".join(f"cast({n} as string) as {n}" for n in FIELDS) + "))")


def bridge_json_line() -> Column:
    """As the bridge writes it: second vocabulary, numbers, its own classification."""
    rules = PROFILES["bridge"]
    code, time_ms = F.col("codigo_respuesta"), F.col("tiempo_respuesta_ms")
    own = [
        F.lit("2025-09-01T00:00:00").alias("processed_at"),
        F.lit("f5_access").alias("log_type"),
        F.lit(rules.version).alias("processor_version"),
        classify.is_error(code, rules).alias("is_error"),
        classify.is_slow(time_ms, rules).alias("is_slow"),
        classify.status_category(code, rules).alias("status_category"),
        classify.response_time_category(time_ms, rules).alias("response_time_category"),
    ]
    return F.to_json(F.struct(*[F.col(n).alias(OTHER_NAMES.get(n, n)) for n in FIELDS], *own))


def envelope_line() -> Column:
    return F.to_json(
        F.struct(
            text_line().alias("message"),
            F.lit("f5_access").alias("log_type"),
            F.lit("2025-09-01T00:00:00").alias("processed_at"),
            F.lit("agent").alias("processed_by"),
            F.lit("1").alias("agent_version"),
        )
    )


def rendered(values: DataFrame, *keep: str) -> DataFrame:
    """Each record as one raw line, in the format named by ``fmt``."""
    line = (
        F.when(F.col("fmt") == "json", json_line())
        .when(F.col("fmt") == "json_old", bridge_json_line())
        .when(F.col("fmt") == "envelope", envelope_line())
        .when(F.col("fmt") == "bad", F.concat(F.lit("corrupt "), text_line()))
        .otherwise(text_line())
    )
    return values.select(*keep, line.alias("value"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``lineitem`` as raw log lines in mixed formats."""
    return rendered(field_values(lineitem(spark, sf_dir)))


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with the time they arrived at."""
    values = field_values(lineitem(spark, sf_dir)).withColumnRenamed("time", "arrived")
    return rendered(values, "arrived")


def write_sorted_files(spark: SparkSession, sf_dir: str, folder: str, files: int = 64) -> None:
    """The same lines in as many files, each sorted by order and plain line, so that every line has a known number."""
    # Only the given columns are shuffled; with the plain line, which orders them, they are sorted, and rendered behind that.
    dealt = lineitem(spark, sf_dir).withColumn("part", F.col("l_orderkey") % files).repartition(files, "part")
    kept = [*COLUMNS, "part"]
    in_order = field_values(dealt, *kept).select(*kept, text_line().alias("plain")).sortWithinPartitions("part", "l_orderkey", "plain")
    rendered(field_values(in_order, "part"), "part").write.option("compression", "gzip").partitionBy("part").text(folder)


SLOT_SECONDS = 21600


def write_arrived_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The same lines in one file for every six hours, which arrives up to ten minutes after they have ended."""
    # Only the given columns are shuffled and sorted; their lines are rendered behind that.
    dealt = lineitem(spark, sf_dir).withColumn("slot", F.expr(f"{SECOND} div {SLOT_SECONDS}"))
    in_order = dealt.repartition("slot").sortWithinPartitions("slot")
    rendered(field_values(in_order, "slot"), "slot").write.option("compression", "gzip").partitionBy("slot").text(folder)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(root, True)
    while found.hasNext():
        path = found.next().getPath()
        slot = path.getParent().getName().partition("=")[2]
        if slot.isdigit():
            seconds = 1754006400 + (int(slot) + 1) * SLOT_SECONDS + int(slot) * 7919 % 600
            fs.setTimes(path, seconds * 1000, -1)


def odd_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records with relative and deep paths, without a node, and with text in a number field."""
    values = field_values(lineitem(spark, sf_dir), "l_partkey")
    kind = F.col("l_partkey") % 5
    path = (
        F.when(kind == 1, F.concat(F.lit("cdn.example.org"), "recurso")).when(kind == 2, "-")
        .when(kind == 3, F.concat("recurso", F.lit("/deep/er/Index.HTML"))).otherwise(F.col("recurso"))
    )
    values = values.withColumns({
        "recurso": path,
        "entorno_nodo": F.when(F.col("l_partkey") % 10 != 0, F.col("entorno_nodo")),
        "tiempo_respuesta_ms": F.when(F.col("l_partkey") % 7 == 0, "slow").otherwise(F.col("tiempo_respuesta_ms").cast("string")),
    })
    return values.select(json_line().alias("value"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``lineitem`` as plain lines."""
    return rendered_text(spark, sf_dir)


def lines_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a landing zone holds them: each partition a stretch of the time they arrived at, all of like size."""
    rows = lineitem_rows(spark, sf_dir)
    # Only the given columns are shuffled; lines are rendered behind that. Rows of one second, or without one, are dealt out too.
    within = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    dealt = rows.repartitionByRange(stretches(spark, sf_dir), F.expr(SECOND), within)
    return rendered(field_values(dealt))


def rendered_text(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return field_values(lineitem(spark, sf_dir), *keep).select(*keep, text_line().alias("value"))


def unquoted_line() -> Column:
    """The line in the layout without quotes around most fields; its cache age is a number."""
    changed = {
        "identidad": "'-'",
        "campo_reservado_1": "'-'",
        "edad_cache": "if(edad_cache = '120', '120', '0')",
    }
    return _filled(UNQUOTED, [changed.get(n, n) for n in FIELDS])


@F.pandas_udf(T.BinaryType())
def gzipped(data: pd.Series) -> pd.Series:
    """Spark has no gzip function; this makes the compressed payloads."""
    return data.map(gzip.compress)
