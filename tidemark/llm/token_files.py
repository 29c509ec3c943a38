"""Token ids as bit-plane shuffled blocks.

Each text is encoded, an end id is appended, and the ids of all documents in
ascending doc_id order form one stream, cut into shards by doc_id range and into
blocks of a fixed number of ids. A block is transposed to byte planes (or bit
planes), so that the rarely changing high planes compress well; each plane is
compressed with zstandard. The file format is a table of blocks, one row each, in
the shared store that Spark writes to (its commit makes a lost task harmless):

  shard, block, first_id    place of the block; first_id counts ids within the shard
  n_ids, unit, plane_bytes  ids held, "byte" or "bit", compressed size of each plane (0: all zeros)
  crc32                     of the ids as little-endian unsigned 32-bit integers
  doc_ids, doc_before, doc_len   the chunk index: documents that the block holds, in order, the ids
                            of each before this block, and its ids in it
  planes                    the compressed planes, one after another

The index columns can be read without the planes. A document may span blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, map_arrow, partitions
from tidemark.llm.tokens import column_steps, default_vocabulary, encoder

#: Ids in a block.
BLOCK_IDS = 65_536
LEVEL = 3

BLOCKS = (
    "shard int, block long, first_id long, n_ids int, unit string, plane_bytes array<int>, crc32 long, "
    "doc_ids array<long>, doc_before array<long>, doc_len array<int>, planes binary"
)
SEGMENTS = "shard int, doc_id long, first_id long, doc_before long, n_ids int, crc32 long, ids binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Transposes ids to four byte planes or 32 bit planes, the lowest first; b"" for a plane of zeros."""
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = as_bytes.T
    else:
        planes = np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    width = n if unit == "byte" else (n + 7) // 8
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if unit == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def _write_blocks(vocabulary: str, block_ids: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), encoder(vocabulary)
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        held, docs, block, first = bytearray(), [], 0, 0

        def row() -> dict:
            planes = to_planes(np.frombuffer(bytes(held), "<u4"), unit)
            packed = [squeeze.compress(p) if p else b"" for p in planes]
            return {
                "shard": shard, "block": block, "first_id": first, "n_ids": len(held) // 4, "unit": unit,
                "plane_bytes": [len(p) for p in packed], "crc32": zlib.crc32(held), "doc_ids": [d for d, _, _ in docs],
                "doc_before": [b for _, b, _ in docs], "doc_len": [n for _, _, n in docs], "planes": b"".join(packed),
            }

        for doc_ids, texts in column_steps(batches):
            ids, ends = coder.encode_column(texts, end=True)
            ids, ends = memoryview(ids).cast("B"), (4 * ends).tolist()
            for doc_id, at, stop in zip(doc_ids, [0, *ends], ends, strict=False):
                begin = at
                while at < stop:
                    part = ids[at : min(stop, at + 4 * block_ids - len(held))]
                    held += part
                    docs.append((doc_id, (at - begin) // 4, len(part) // 4))
                    at += len(part)
                    if len(held) == 4 * block_ids:
                        yield pa.RecordBatch.from_pylist([row()], schema=_arrow_blocks())
                        first, block, docs = first + block_ids, block + 1, []
                        held.clear()
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema=_arrow_blocks())

    return run


def _arrow_blocks() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in BLOCKS.split(", "))])


def write_tokens(docs: DataFrame, path: str, *, vocabulary: str | None = None, block_ids: int = BLOCK_IDS, unit: str = "byte", shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the stream of ids to path.

    A null text counts as empty and still has its end id. Rows that repeat a doc_id
    are stored once each, in the order of their texts; other columns are not read. An
    empty table leaves a file without blocks. unit is "byte" or "bit".
    """
    n = shards or partitions(docs.sparkSession)
    ordered = documents(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    step = _write_blocks(vocabulary or default_vocabulary(), block_ids, unit)
    map_arrow(ordered, step, BLOCKS).write.option("compression", "none").parquet(path)


def _read_segments(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                at, planes = 0, []
                for size in r["plane_bytes"]:
                    planes.append(plain.decompress(r["planes"][at : at + size]) if size else b"")
                    at += size
                raw = from_planes(planes, r["n_ids"], r["unit"]).tobytes()
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
                ends = 4 * np.cumsum(r["doc_len"], dtype=np.int64)
                parts = [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), r["doc_len"], strict=True)]
                first = r["first_id"] + ends // 4 - np.array(r["doc_len"]) - np.array(r["doc_before"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * len(parts), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(first, pa.int64()),
                        pa.array(r["doc_before"], pa.int64()), pa.array(r["doc_len"], pa.int32()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                    ],
                    names=["shard", "doc_id", "first_id", "doc_before", "n_ids", "crc32", "ids"],
                )

    return run


def read_segments(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document and block from the stored planes; first_id is the document's first place in its shard."""
    return map_arrow(spark.read.parquet(path), _read_segments(with_ids), SEGMENTS)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bit 31 the constant."""
    out = 0
    for i in range(32):
        if a & (1 << (31 - i)):
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def join_crc32(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings, one after the other, from those of each."""
    power, shift, bits = 1 << 31, 1 << 30, 8 * second_bytes
    while bits:
        if bits & 1:
            power = _times(power, shift)
        shift, bits = _times(shift, shift), bits >> 1
    return _times(first, power) ^ second


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, lengths = [], []
        for parts in batch.column(2).to_pylist():
            crc = total = 0
            for p in sorted(parts, key=lambda x: x["doc_before"]):
                crc = join_crc32(crc, p["crc32"], 4 * p["n_ids"]) if total else p["crc32"]
                total += p["n_ids"]
            crcs.append(crc)
            lengths.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document its place in the stream, its ids and their crc32, all from the files."""
    index = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = index.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    parts = read_segments(spark, path, with_ids=False).join(F.broadcast(before), "shard")  # a row for each shard
    grouped = parts.groupBy("doc_id", (F.col("before") + F.col("first_id")).alias("start")).agg(
        F.collect_list(F.struct("doc_before", "n_ids", "crc32")).alias("parts")
    )
    return map_arrow(grouped, _join_segments, DOCUMENTS)
