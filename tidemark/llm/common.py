"""What the operators share: the shared folder, written intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package

#: Rows that Spark hands to Python at once: whole texts travel in them.
ROWS_PER_BATCH = 256
#: Characters that one vectorised step works on.
CHARS_PER_STEP = 2_000_000
#: The folder for written tables where the session names none, on one machine only.
OWN_SHARED_DIR = "/tmp/checkpoints/tidemark"
#: Tables written inside scratch().
_SCRATCH: list[str] = []
_OPEN: list[bool] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's spark.checkpoint.dir; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or OWN_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut of the lineage that outlives any executor."""
    path = new_path(df.sparkSession, name)
    if _OPEN:
        _SCRATCH.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Tables that stash writes inside are given back by the next release()."""
    _OPEN.append(True)
    try:
        yield
    finally:
        _OPEN.pop()


def release(spark: SparkSession, needed: DataFrame) -> None:
    """Deletes the tables written inside scratch() so far, but for those that a table still reads."""
    files = needed.inputFiles() if _SCRATCH else []
    names = {part for f in files for part in f.split("/")}
    for path in [p for p in _SCRATCH if p.rsplit("/", 1)[-1] not in names]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _SCRATCH.remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """Python gets few rows at a time, as a row may hold a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(step, schema)


def text_steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHARS_PER_STEP characters each, a longer text alone."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHARS_PER_STEP:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator on texts needs, under its own names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
