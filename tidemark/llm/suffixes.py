"""Removal of long repeated substrings by bucket-pointer refinement of suffixes.

A suffix matters only down to `length` bytes: two suffixes that agree so far repeat a
string. Buckets hold suffixes that agree in a first q-gram, and are refined by the
bucket identifiers of later offsets: identifiers for depth 2q come from those of a suffix
and of the one q bytes later, those for 4q from two of 2q, and so on, each level reusing
the last. A bucket of one suffix is settled and dropped. Identifiers are 64-bit
fingerprints of content, so that every executor names a bucket alike without an exchange
of ranks.

Not every suffix has to be sorted. Every string of `length` bytes holds q-grams at
length - q + 1 places; the leftmost one of the least hash is its anchor, which is the
same wherever the string occurs. First, anchors are counted by their q-gram; those of one
occurrence end the matter for all strings anchored there. Second, the stretches of text
around the other anchors are dealt out by q-gram, and in each bucket the suffixes that
share the anchor are refined to `length` bytes. The stretches of a q-gram with more
occurrences than one task should hold are dealt to several tasks; each finds what
repeats among its own, and gives the refined identifier of every distinct suffix once,
to be counted over all tasks.

Copies of a whole text count as one text while suffixes are compared; a text that has a
copy is covered by it altogether.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, partitions, stash, text_steps
from tidemark.llm.grams import BASE, mix, rolling, sliding_min
from tidemark.llm.repeats import key_filter, may_hold

LENGTH = 200
#: A q-gram is a quarter of the length, so that two refinements reach the full depth.
PARTS = 4
#: Stretches that are compared together: a q-gram with more occurrences is frequent and dealt to several tasks.
FREQUENT, DEALT = 20_000, 64


def anchors(raw: np.ndarray, ends: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: q-gram identifier of each anchor, and the first and last start of the strings anchored there."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none
    q = length // PARTS
    width = length - q + 1
    ids = mix(rolling(raw, q))
    least = sliding_min(ids, width)
    valid = np.ones(len(least), bool)
    for end in ends:  # strings don't cross from one text to the next
        valid[max(0, end - length + 1) : end] = False
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none.astype(np.uint64), none, none
    stop = np.flatnonzero(np.append(fresh | ~valid, True))
    last = stop[np.searchsorted(stop, first, "right")] - 1
    # The least q-gram either came in on the right or has to be looked for.
    before = np.maximum(first - 1, 0)
    entered = (first > 0) & valid[before] & (least[before] > least[first]) & (ids[first + width - 1] == least[first])
    at = first + width - 1
    for part in np.array_split(np.flatnonzero(~entered), 1 + (~entered).sum() // 20_000):
        at[part] = first[part] + sliding_window_view(ids, width)[first[part]].argmin(axis=1)
    more = []
    for k in np.flatnonzero(last > at):  # the same q-gram again before the strings end
        low, high, place = int(first[k]), int(last[k]), int(at[k])
        last[k] = place
        while place < high:
            low = place + 1
            place = low + int((ids[low : low + width] == least[low]).argmax())
            more.append((low, min(place, high), place))
    if more:
        extra = np.array(more, np.int64)
        first, last, at = np.append(first, extra[:, 0]), np.append(last, extra[:, 1]), np.append(at, extra[:, 2])
    return ids[at], first, last


def refine(stretch: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers at full depth of all suffixes in a stretch of text, from the q-grams upward."""
    size = length // PARTS
    ids = mix(rolling(stretch, size))
    while size < length:
        ids = mix(ids[:-size] * np.uint64(BASE) + mix(ids[size:]))
        size *= 2
    return ids


def text_key(raw: bytes) -> str:
    """Names a whole text: half of its SHA-256."""
    return hashlib.sha256(raw).hexdigest()[:32]


def _joined(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, list[int]]:
    raws = [(t or "").encode() for t in texts]
    return raws, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]).tolist()


def _count_grams(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in text_steps(texts):
                _, raw, ends = _joined(list(dict.fromkeys(texts[i:j])))
                keys, n = np.unique(anchors(raw, ends, length)[0].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


STRETCHES = "gram long, frequent boolean, text_id string, first int, bytes binary"


def _cut_stretches(length: int, bits: np.ndarray, frequent: np.ndarray | None):
    """The stretches whose q-gram the first filter may hold; frequent ones are those that the second may hold, of all occurrences alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in text_steps(texts):
                raws, raw, ends = _joined(list(dict.fromkeys(texts[i:j])))
                gram, first, last = anchors(raw, ends, length)
                passes = may_hold(bits, gram)
                gram, first, last = gram[passes].view(np.int64), first[passes], last[passes]
                of = np.searchsorted(ends, first, "right")
                names = {k: text_key(raws[k]) for k in np.unique(of).tolist()}
                whole, starts = raw.tobytes(), first - np.array([0, *ends])[of]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram), pa.array(np.zeros(len(gram), bool) if frequent is None else may_hold(frequent, gram.view(np.uint64))), pa.array([names[k] for k in of.tolist()], pa.string()), pa.array(starts.astype(np.int32)),
                        pa.array([whole[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["gram", "frequent", "text_id", "first", "bytes"],
                )

    return run


RUNS = "text_id string, first int, last int"


def _runs(names: list[str], first: np.ndarray, counts: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """Stretches of neighbouring repeated starts; counts: suffixes of each row, laid end to end in repeated."""
    row = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    on = repeated.copy()
    on[1:] &= ~repeated[:-1] | (row[1:] != row[:-1])
    off = repeated.copy()
    off[:-1] &= ~repeated[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(on), np.flatnonzero(off)
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in row[a].tolist()], pa.string()), pa.array((first[row[a]] + offset[a]).astype(np.int32)), pa.array((first[row[b]] + offset[b]).astype(np.int32))], names=["text_id", "first", "last"])


def _refined(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the suffixes of all stretches, end to end, and how many each has."""
    sizes = np.array([len(b) for b in blobs])
    ids = refine(np.frombuffer(b"".join(blobs), np.uint8), length)
    counts = sizes - length + 1
    starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return ids[starts], counts


def _compare(length: int, rows_at_once: int = FREQUENT):
    """Rows come sorted by q-gram; all of one q-gram are compared together."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({(r[1], r[2]): r for r in held}.values())  # copies of a text, from several tasks
        if len(rows) < 2:
            return
        ids, counts = _refined([r[3] for r in rows], length)
        _, which, n = np.unique(ids, return_inverse=True, return_counts=True)
        yield _runs([r[1] for r in rows], np.array([r[2] for r in rows]), counts, n[which] > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= rows_at_once and row[0] != held[-1][0]:
                    yield from flush(held)
                    held = []
                held.append(row)
        yield from flush(held)

    return run


SPELT = "text_id string, first int, last int, id long"


def _spell_out(length: int, rows_at_once: int = FREQUENT):
    """Of a frequent q-gram's stretches: runs of suffixes that repeat among the rows at hand (id null), and one row for each distinct suffix there."""

    def flush(held: dict[tuple, bytes]) -> Iterator[pa.RecordBatch]:
        names, first = [k[0] for k in held], np.array([k[1] for k in held])
        ids, counts = _refined(list(held.values()), length)
        _, one, which, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        known = _runs(names, first, counts, n[which] > 1)
        yield pa.RecordBatch.from_arrays([*known.columns, pa.nulls(known.num_rows, pa.int64())], names=["text_id", "first", "last", "id"])
        row = np.repeat(np.arange(len(counts)), counts)
        at = pa.array((first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))[one].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in row[one].tolist()], pa.string()), at, at, pa.array(ids[one].view(np.int64))], names=["text_id", "first", "last", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, bytes] = {}
        for batch in batches:
            for name, first, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[name, first] = blob
            if len(held) >= rows_at_once:
                yield from flush(held)
                held = {}
        if held:
            yield from flush(held)

    return run


def repeated_starts(texts: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """Runs (text_id, first, last) of the byte offsets at which a string starts that also starts elsewhere, copies of whole texts apart."""
    spark = texts.sparkSession
    grams = map_arrow(texts.select("text"), _count_grams(length), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    shared = stash(grams.filter("n > 1"), "repeated-grams")
    often = shared.filter(F.col("n") > FREQUENT).select("gram")
    count, frequent = shared.count(), often.count()
    bits = key_filter(shared, "gram", count), key_filter(often, "gram", frequent) if frequent else None
    cut = stash(map_arrow(texts.select("text"), _cut_stretches(length, *bits), STRETCHES), "stretches")
    together = cut.filter("not frequent").select("gram", "text_id", "first", "bytes").repartition(4 * partitions(spark), "gram").sortWithinPartitions("gram")
    runs = stash(map_arrow(together, _compare(length), RUNS), "runs")
    if not frequent:
        return runs
    dealt = cut.filter("frequent").repartition(4 * partitions(spark), "gram", F.pmod(F.xxhash64("text_id", "first"), F.lit(DEALT)))
    spelt = stash(map_arrow(dealt.select("text_id", "first", "bytes"), _spell_out(length), SPELT), "frequent-suffixes")
    own = spelt.filter("id is not null").select("text_id", "first", "id").distinct()
    many = stash(own.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "frequent-buckets").select("id")
    known = spelt.filter("id is null").select("text_id", "first", "last")
    return runs.unionByName(known).unionByName(own.join(many, "id").select("text_id", "first", F.col("first").alias("last")))


RESULT = "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"


def _whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """A span without the characters that it covers in part."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _remove(length: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, copied, runs in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = [[0, len(raw)]] if copied and len(raw) >= length else []
                for r in sorted(runs or [], key=lambda r: r["first"]):
                    if merged and r["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["last"] + length)
                    else:
                        merged.append([r["first"], r["last"] + length])
                if as_text:
                    merged = [list(_whole_characters(raw, a, b)) for a, b in merged]
                edges = [0, *(x for s in merged for x in s), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            more = batch.columns[4:]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), *more], names=["doc_id", "n_bytes", "spans", "kept", "carried"][: 4 + len(more)]
            )

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, as_text: bool = False, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts at another place, in any document.

    Returns per document doc_id, n_bytes, spans (maximal removed runs, in bytes) and kept
    (the remaining UTF-8 bytes joined; a string with as_text, where characters that a run
    covers in part stay). Strings are judged on the input. Null texts are empty; texts
    shorter than `length` stay whole. Rows with equal texts are copies of each other,
    whatever their ids, which may be null. length is a multiple of four. carry names
    columns to return in a struct named carried; other columns are not read. An empty
    table gives no rows.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    wide = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *row)
    docs = wide.select("doc_id", "text")
    named = stash(docs.select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("text_id")), "text-ids")
    copied = stash(named.groupBy("text_id").agg(F.count("*").alias("n")).filter("n > 1"), "copied-texts").select("text_id", F.lit(True).alias("copied"))
    marked = stash(named.join(copied, "text_id", "left").select("doc_id", "text_id", F.coalesce("copied", F.lit(False)).alias("copied")), "marked-texts")
    runs = repeated_starts(docs, length=length).groupBy("text_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    single = marked.filter("not copied").join(runs, "text_id").select("doc_id", "text_id", "copied", "runs")
    decided = stash(single.unionByName(marked.filter("copied").distinct().withColumn("runs", F.lit(None).cast("array<struct<first: int, last: int>>"))), "removals")
    own_key = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)
    found = decided.withColumnsRenamed({"doc_id": "found_id", "text_id": "found_text"})
    ready = wide.withColumn("text_id", own_key).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_id") == F.col("found_text")), "left")
    more = f", carried {ready.schema['carried'].dataType.simpleString()}" if carry else ""
    out = map_arrow(ready.select("doc_id", "text", "copied", "runs", *(["carried"] if carry else [])), _remove(length, as_text), RESULT + more)
    return out.withColumn("kept", F.decode("kept", "UTF-8")) if as_text else out
