"""The two batch pipelines: raw records in, classified table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logbasin.functions import classify
from logbasin.operators import enrich, parse
from logbasin.schema import OTHER_NAMES, PARTITIONS
from logbasin.session import new_folder
from logbasin.sources import writers


def requests(lines: DataFrame, **options) -> DataFrame:
    """The request table of a batch of raw lines in any format."""
    return enrich.request_table(parse.accepted(parse.parse_lines(lines, **options)))


def gathered_requests(records: DataFrame) -> DataFrame:
    """The request table of accepted records, an hour's rows together, ready to be written without a further shuffle.

    Rows are shuffled as they were parsed; what can be derived from them is added behind the shuffle.
    """
    return enrich.request_table(writers.by_partition(records))


def ordered_requests(records: DataFrame) -> DataFrame:
    """The request table of accepted records that come in order of time, ready to be written without a shuffle.

    A task sorts its records by the hour as they were parsed; what can be derived from them is added behind the sort, which
    keeps the optimizer from parsing a field again for each column derived from it.
    """
    return enrich.request_table(records.sortWithinPartitions(*PARTITIONS))


def classified_records(lines: DataFrame, **options) -> DataFrame:
    """Accepted and rejected records with their classification, for ingest metrics."""
    records = enrich.enrich(parse.parse_lines(lines, **options))
    flag = classify.needs_alert(F.col("codigo_respuesta"), F.col("tiempo_respuesta_ms"), F.col("tamano_respuesta"))
    return records.withColumn("needs_alert", flag)


def observed(records: DataFrame, name: str | Observation = "ingest") -> DataFrame:
    """Count what passes through while it is written, without a second read (see ``Observation``)."""
    ok = F.col("reject_reason").isNull()
    return records.observe(
        name,
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("record_format") == "json").alias("json_records"),
        F.count_if(F.col("record_format") == "text").alias("text_records"),
        F.count_if(ok).alias("parsed_successfully"),
        F.count_if(~ok).alias("rejected"),
    )


def run(lines: DataFrame, table: str, rejects: str, run_id: str, **options) -> dict[str, int]:
    """Parse once, store accepted and rejected records, and return the counts taken on the way.

    The parsed records are staged in the shared folder by outcome, accepted ones
    without their line; both outputs are read from there. Rejects go under the run's own folder, which a retry replaces;
    the append to the table comes last and is committed as one job, so a run that
    failed at any step can be repeated. Stored hours keep their earlier rows.
    """
    spark, staged, seen = lines.sparkSession, new_folder(lines.sparkSession, "parsed"), Observation()
    outcome = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
    records = observed(parse.parse_lines(lines, **options), seen).withColumn("outcome", outcome)
    records = records.withColumn("line", F.when(F.col("outcome") == "rejected", F.col("line")))
    records.write.option("compression", "zstd").partitionBy("outcome").parquet(staged)
    stored = spark.read.schema(records.schema).parquet(staged)
    refused = parse.rejected(stored.where("outcome = 'rejected'"))
    writers.write_rejects(refused, f"{rejects}/run={run_id}", mode="overwrite")
    good = parse.accepted(stored.where("outcome = 'accepted'")).drop("outcome")
    writers.write_requests(gathered_requests(good), table, gather=False)
    return seen.get


def to_second_vocabulary(df: DataFrame) -> DataFrame:
    names = {**OTHER_NAMES, "parsed_timestamp_apache": "parsed_timestamp_rp"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def legacy_requests(df: DataFrame, base_year: int | None = None, layout: str = "strict") -> DataFrame:
    """The older pipeline: columns or raw lines, whichever the input holds, in the second vocabulary."""
    shape = parse.input_shape(df)
    if shape == "preparsed":
        records = parse.preparsed_records(df)
    else:
        lines = df.select(F.col(shape).alias("value")).where("value is not null")
        raw = parse.raw_records(lines, layout=layout, unwrap=False, min_length=0).where(
            "record_format = 'text' and reject_reason is null"
        )
        raw = raw.drop("record_format", "reject_reason").withColumnRenamed("line", "raw_log")
        records = parse.typed_records(raw, "legacy", base_year)
    return to_second_vocabulary(enrich.enrich(records, "legacy_native"))
