"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A bad input file stops the job; it is never dropped without notice.
    "spark.sql.files.ignoreCorruptFiles": "false",
    "spark.sql.files.ignoreMissingFiles": "false",
    # The JVM never compiles a method beyond this size; a stage over a wide row
    # runs faster split up than fused into one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# On one machine the cost of a write is the number of files a task opens, not
# the bytes it moves, so small partitions are kept apart.
LOCAL_SETTINGS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k"}


def get_session(app_name: str = "logbasin", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    """Bring a session made elsewhere to the same settings; what its owner set is kept."""
    owned = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    for key, value in {**SETTINGS, **(LOCAL_SETTINGS if local else {})}.items():
        if not owned.contains(key):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="logbasin-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/logbasin/{label}-{uuid.uuid4().hex}"
