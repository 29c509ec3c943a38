"""A bit filter of the 64-bit keys that a table holds, of bounded size, for a second pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

#: 32 MB; a fuller filter lets more keys pass that it need not, and never holds one back.
FILTER_BITS = 1 << 28
_BLOCK = 1 << 20


def _bits_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = min(bits, _BLOCK), {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            for b in np.unique(at // np.uint64(block)).tolist():
                own = at[at // np.uint64(block) == b] % np.uint64(block)
                held.setdefault(b, np.zeros(block, bool))[own.astype(np.int64)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    return run


def key_filter(keys: DataFrame, column: str, count: int) -> np.ndarray:
    """Sets a bit for every key; count is the number of keys, which sizes the filter up to FILTER_BITS."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * count).bit_length()))
    block = min(bits, _BLOCK)
    out = np.zeros(bits // 8, np.uint8)
    placed = keys.select(F.col(column).alias("key"), F.shiftright(F.col(column).bitwiseAND(bits - 1), 20).alias("block"))
    for r in map_arrow(placed.repartition(max(1, bits // block), "block").select("key"), _bits_of(bits), "block long, bits binary").toLocalIterator():
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (unsigned 64-bit) may be in the table."""
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
