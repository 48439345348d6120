"""A catalog table that follows its folder: new partitions, new columns, wider types.

A crawl looks only at folders that are new since the last one: behind the newest partition it knew, or changed since it
ran. Footers are read there and nowhere else. The mark is kept in the table's properties. Partitions whose folders have
gone stay in the catalog, and so do columns; old days give null for a column that came later.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logbasin.schema import PARTITIONS

MARK, LAST_RUN = "crawl.mark", "crawl.time"
# Folder times of some stores are whole seconds.
SLACK_MS = 2000
# Wider than the types before it, and readable as such from older files.
WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
DAYS = [T.DateType(), T.TimestampNTZType()]


class SchemaConflict(ValueError):
    """Two types of a column that no wider type can hold."""


@dataclass
class Crawl:
    """What a crawl has found."""

    partitions: int = 0
    added: list[str] = field(default_factory=list)
    widened: list[str] = field(default_factory=list)


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    for ladder in (WHOLE, DAYS):
        if a in ladder and b in ladder:
            return ladder[max(ladder.index(a), ladder.index(b))]
    real = (T.FloatType(), T.DoubleType())
    if all(t in real or t in WHOLE[:3] for t in (a, b)):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        if scale + whole <= 38:
            return T.DecimalType(scale + whole, scale)
    raise SchemaConflict(f"no type holds both {a.simpleString()} and {b.simpleString()}")


def merged(schemas: list[T.StructType]) -> T.StructType:
    """All columns, in order of appearance, each in the widest of its types."""
    found: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema:
            try:
                found[f.name] = wider(found.get(f.name, f.dataType), f.dataType)
            except SchemaConflict as e:
                raise SchemaConflict(f"{f.name}: {e}") from e
    return T.StructType([T.StructField(n, t) for n, t in found.items()])


def _new_folders(spark: SparkSession, path: str, keys: list[str], mark: list[int], since: int) -> list[tuple[str, list[str]]]:
    """(folder, values) of the partitions behind the mark or changed since; older ones are not opened."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level = [(root, [])]
    for depth, key in enumerate(keys):
        following = []
        for folder, values in level:
            for child in fs.listStatus(folder):
                name, _, value = child.getPath().getName().partition("=")
                if not child.isDirectory() or name != key:
                    continue
                numbers = [int(v) if v.isdigit() else -1 for v in [*values, value]]
                last = depth == len(keys) - 1
                behind = numbers > mark[: depth + 1] or (not last and numbers == mark[: depth + 1]) or not mark
                if behind or child.getModificationTime() >= since - SLACK_MS:
                    following.append((child.getPath(), [*values, value]))
        level = following
    level.sort(key=lambda found: [int(v) if v.isdigit() else -1 for v in found[1]])
    return [(folder.toString(), values) for folder, values in level]


def _footers(spark: SparkSession, folders: list[str]) -> T.StructType:
    """The merged schema of all files of the folders, read by Spark's tasks; where types differ, of each half."""
    try:
        return spark.read.option("mergeSchema", True).parquet(*folders).schema
    except (PySparkException, Py4JJavaError) as e:
        if "merge" not in str(e).lower():
            raise
    if len(folders) == 1:
        raise SchemaConflict(f"{folders[0]}: its files differ in a type")
    # Types differ between neighbours in time at few places, so halves soon agree in themselves.
    half = len(folders) // 2
    return merged([_footers(spark, folders[:half]), _footers(spark, folders[half:])])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _create(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: list[str]) -> None:
    columns = _ddl(schema) + "".join(f", `{k}` int" for k in keys)
    spark.sql(f"create table {name} ({columns}) using parquet partitioned by ({', '.join(keys)}) location '{path}'")


def _spec(keys: list[str], values: list[str]) -> str:
    return ", ".join(f"{k} = {v if v.isdigit() else 'null'}" for k, v in zip(keys, values))


def _add_partitions(spark: SparkSession, name: str, keys: list[str], partitions: list[list[str]], batch: int = 500) -> None:
    for i in range(0, len(partitions), batch):
        specs = " ".join(f"partition ({_spec(keys, v)})" for v in partitions[i : i + batch])
        spark.sql(f"alter table {name} add if not exists {specs}")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"show tblproperties {name}").collect()}


def crawl(spark: SparkSession, name: str, path: str, keys: list[str] = PARTITIONS) -> Crawl:
    """Create the table or bring it up to date with its folder."""
    keys, began = list(keys), int(time.time() * 1000)
    known = spark.catalog.tableExists(name)
    held = _properties(spark, name) if known else {}
    mark = [int(v) for v in held[MARK].split("/")] if held.get(MARK) else []
    found = _new_folders(spark, path, keys, mark, int(held.get(LAST_RUN, 0)))
    out = Crawl(partitions=len(found))
    if not found:
        return out
    new = _footers(spark, [f for f, _ in found])
    new = T.StructType([f for f in new if f.name not in keys])
    if not known:
        _create(spark, name, path, new, keys)
        out.added = new.names
    else:
        old = T.StructType([f for f in spark.table(name).schema if f.name not in keys])
        both = merged([old, new])
        out.added = [n for n in both.names if n not in old.names]
        out.widened = [f.name for f in old if both[f.name].dataType != f.dataType]
        if out.widened:
            before = [[p.partition("=")[2] for p in r["partition"].split("/")] for r in spark.sql(f"show partitions {name}").collect()]
            spark.sql(f"drop table {name}")
            _create(spark, name, path, both, keys)
            _add_partitions(spark, name, keys, before)
        elif out.added:
            columns = T.StructType([both[n] for n in out.added])
            spark.sql(f"alter table {name} add columns ({_ddl(columns)})")
    _add_partitions(spark, name, keys, [v for _, v in found])
    newest = max([mark, *[[int(x) if x.isdigit() else -1 for x in v] for _, v in found]])
    spark.sql(f"alter table {name} set tblproperties ('{MARK}' = '{'/'.join(map(str, newest))}', '{LAST_RUN}' = '{began}')")
    return out


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
