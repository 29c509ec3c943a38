"""Best-fit decreasing packing of token sequences.

Every document is encoded and cut into pieces of at most `capacity` ids. Best-fit
decreasing takes pieces from the longest to the shortest and puts each into the
tightest open bin that holds it. Lengths and remaining capacities are integers up to
`capacity`, and pieces of one length, as bins of one remaining capacity, are
interchangeable; the choice for all pieces of the corpus therefore follows from the
histogram of lengths alone (`capacity` numbers). A segment tree over remaining
capacities finds the tightest open bin in logarithmic time; consecutive pieces with
like placements form one run (length, first rank, first bin, pieces to a bin, offset).
The pieces themselves never leave their partitions: a piece's rank among those of its
length, from counts per task, tells its run, bin and offset.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, map_arrow, stash
from tidemark.llm.tokens import column_steps, default_vocabulary, encoder

CAPACITY = 1024

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long, ids binary"


class TightestFit:
    """Segment tree over remaining capacities: which is the least one, at least as large, with an open bin?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, length: int) -> int | None:
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of like placements, as rows (length, first rank, pieces, first bin, pieces to a bin, offset), in best-fit decreasing order."""
    tree, bins, runs, new_bin = TightestFit(capacity), defaultdict(list), [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            bins[remaining].append((first, count))
            tree.mark(remaining, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.find(length)
            if remaining is None:
                count = -(-left // (capacity // length))
                put(capacity, new_bin, count)
                new_bin, remaining = new_bin + count, capacity
            first, count = bins[remaining].pop()
            if not bins[remaining]:
                tree.mark(remaining, False)
            # A bin that was tightest stays so until the next piece doesn't fit.
            each = remaining // length
            full = min(count, left // each)
            used, each = (full, each) if full else (1, left)
            runs.append((length, rank, used * each, first, each, capacity - remaining))
            put(remaining - each * length, first, used)
            put(remaining, first + used, count - used)
            rank, left = rank + used * each, left - used * each
    return np.array(runs, np.int64).reshape(-1, 6)


def _cut(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder, seen = TaskContext.get().partitionId(), encoder(vocabulary), defaultdict(int)
        for doc_ids, texts in column_steps(batches):
            ids, ends = coder.encode_column(texts, end=True)
            ids, ends, out = memoryview(ids).cast("B"), ends.tolist(), []
            for doc_id, begin, stop in zip(doc_ids, [0, *ends], ends, strict=False):
                n = stop - begin
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * (begin + a) : 4 * (begin + b)]
                    out.append((doc_id, k, a, b - a, zlib.crc32(part), task, seen[b - a], bytes(part) if with_ids else None))
                    seen[b - a] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in PIECES.split(", ")])

    return run


def _place(runs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs are sorted by length and rank, so that one number orders them.
        table = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        span = 1 + int(table[:, 1].max(initial=0) + table[:, 2].max(initial=0))
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            _, first, _, first_bin, each, offset = table[np.searchsorted(keys, length * span + rank, "right") - 1].T
            placed = {"sequence_id": first_bin + (rank - first) // each, "offset": offset + (rank - first) % each * length}
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *(pa.array(v, pa.int64()) for v in placed.values())], names=[*names, *placed])

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` ids as best-fit decreasing finds.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids, little-endian unsigned 32-bit, if asked for). Only documents longer than
    `capacity` are cut; their first piece may be shorter. A null or empty text is its end
    id alone. Rows that repeat a doc_id are packed once each. An empty table gives no rows.
    """
    cut = map_arrow(documents(docs, id_col, text_col), _cut(vocabulary or default_vocabulary(), capacity, with_ids), PIECES)
    pieces = stash(cut, "pieces")
    counts = stash(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task")
    firsts = counts.select("length", "task", (F.sum("n").over(before) - F.col("n")).alias("before"))
    # a row for each length and task: shuffled with the pieces, not broadcast, as it grows with the input
    ranked = pieces.join(firsts.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return map_arrow(ranked, _place(best_fit_runs(histogram, capacity)), schema).withColumn("length", F.col("length").cast("long"))
