"""Session helpers: table access, shared folders and worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
#: Rows and bytes that one Arrow batch may hold, so that long texts don't pile up in a worker.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound Arrow batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session gets a temporary folder; a
    cluster session raises, since no local folder would do there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.tessera.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.shared.dir", base)
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"


#: Tasks that groups of heavy work are dealt to.
GROUP_TASKS = 256


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, over a fixed number of tasks: few bytes with much work each would else be put together in one task."""
    return df.repartition(GROUP_TASKS, *keys)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
