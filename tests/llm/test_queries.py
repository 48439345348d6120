"""The registered queries beside their SQL, and the stages of the pipeline."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, compare
from logbasin.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert compare(name, found, db.sql(queries.ORACLES[name]).df()) == ""


def test_pipeline(spark, tmp_path):
    docs = before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts[name] = docs.count()
        assert docs.columns[: len(COLUMNS)] == COLUMNS and (name == "pieces" or len(docs.columns) == len(COLUMNS))
    assert 0 < counts["minhash_dedup"] < counts["quality"] < before.count()
    assert counts["mixing"] == counts["pieces"] == docs.where("lossless").count()
