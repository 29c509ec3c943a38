"""Tables written to the folder that all executors share, to cut a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder where the session names none, on one machine only.
OWN_SHARED_DIR = "/tmp/checkpoints/tidemark"


def shared_dir(spark: SparkSession) -> str:
    """From the session's spark.checkpoint.dir; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or OWN_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table and reads it back."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
