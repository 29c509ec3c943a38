"""A JSON log of bounded size as a sink for batches and streams: two generations of files, the older dropped as a whole.

Tasks write their rows to files of their own; a commit lists these in a manifest that is
replaced in one step, so a batch is there whole or not at all. A stream's batch that was
committed before is passed over when it comes again. Before a commit a generation larger
than the limit becomes the old one, and what was old goes. The folder has to be one that
the driver and all executors see as files; one query at a time writes to it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: a generation that is larger is rotated.
MAX_BYTES = 8 * 1024 * 1024
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)


def manifest(folder: str) -> dict:
    at = Path(folder, MANIFEST)
    return json.loads(at.read_text()) if at.exists() else {"old": [], "current": [], "bytes": 0, "batch": -1}


class _Log:
    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes = folder, max_bytes

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        file = f"part-{uuid.uuid4().hex}.jsonl"
        with open(Path(self.folder, file), "w", encoding="utf-8") as out:
            for row in rows:
                out.write(json.dumps(_plain(row), ensure_ascii=False, separators=(",", ":")) + "\n")
        return Written(file, os.path.getsize(Path(self.folder, file)))

    def _drop(self, files) -> None:
        for file in files:
            Path(self.folder, file).unlink(missing_ok=True)

    def add(self, messages: list[Written | None], batch: int | None) -> None:
        files = [m for m in messages if m is not None]
        state = manifest(self.folder)
        if batch is not None and batch <= state["batch"]:
            listed = {*state["old"], *state["current"]}
            self._drop(m.file for m in files if m.file not in listed)
            return
        gone = []
        if state["bytes"] > self.max_bytes:
            gone, state = state["old"], state | {"old": state["current"], "current": [], "bytes": 0}
        kept = [m for m in files if m.size]
        state = state | {"current": state["current"] + [m.file for m in kept], "bytes": state["bytes"] + sum(m.size for m in kept), "batch": state["batch"] if batch is None else batch}
        os.makedirs(self.folder, exist_ok=True)
        fresh = Path(self.folder, f".{uuid.uuid4().hex}")
        fresh.write_text(json.dumps(state))
        os.replace(fresh, Path(self.folder, MANIFEST))
        self._drop([*gone, *(m.file for m in files if not m.size)])

    def forget(self, messages: list[Written | None]) -> None:
        self._drop(m.file for m in messages if m is not None)


class _BatchWriter(_Log, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.add(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self.forget(messages)


class _StreamWriter(_Log, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.add(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.forget(messages)


class RotatingJson(DataSource):
    """Options: path, and maxBytes (8 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "rotating_json"

    def _writer(self, kind):
        return kind(self.options["path"].removeprefix("file://"), int(self.options.get("maxBytes", MAX_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("rotating_json only appends")
        return self._writer(_BatchWriter)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return self._writer(_StreamWriter)


def register(spark: SparkSession) -> None:
    from tidemark.functions.shipping import ship_package

    ship_package(spark)
    spark.dataSource.register(RotatingJson)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of both generations."""
    state = manifest(folder.removeprefix("file://"))
    files = [f"{folder}/{f}" for f in state["old"] + state["current"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
