"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one run of bytes. The two cuts of each text are read off a scan of its
tokens; each of the three parts then has one place in the batch and one in the output, and
so one shift. Differences of neighbouring shifts are written at the parts' first bytes,
their running sum gives every byte its shift, and one scatter builds all outputs of the
batch. Restoring finds the marks in an output, sums the shifts the other way and gathers.
Running sums are made tile by tile, so that what a long text needs beside its own bytes
stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

#: Marks of the parts; each is three bytes, and no text that is cut holds one.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SEED = 42
#: Of 100 texts, those that are cut; of 100 cut ones, those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes whose shifts are held at once.
TILE = 1 << 21

OUTPUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def shifts(size: int, starts: np.ndarray, moved: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all bytes and where they are moved, in tiles, from the ascending starts of parts and their shifts."""
    steps, carry = np.diff(moved, prepend=0), 0
    for low in range(0, size, TILE):
        high = min(size, low + TILE)
        first, last = np.searchsorted(starts, (low, high))
        shift = np.zeros(high - low, np.int64)
        np.add.at(shift, starts[first:last] - low, steps[first:last])
        np.cumsum(shift, out=shift)
        shift += carry
        carry = shift[-1]
        places = np.arange(low, high)
        yield places, places + shift


def marks_in(data: np.ndarray) -> np.ndarray:
    """Places of all marks."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    letter = data[1:-1]
    return np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & ((letter == 80) | (letter == 83) | (letter == 77)))


def _rows_of(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of the marks at these places; a mark across two rows is none and has row -1."""
    row = np.searchsorted(offsets, places, "right") - 1
    return np.where(places + MARK <= offsets[row + 1], row, -1) if len(places) else row


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one run, and the rows' offsets in it."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _column(kind: pa.DataType, data: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(lengths), [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _transform(seed: int, rate: int, suffix_first: int):
    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _bytes_of(batch.column(1))
        sizes = np.diff(offsets)
        ends = (data == 32) | ((data >= 9) & (data <= 13))  # spaces, then last bytes of tokens
        ends[:-1] = ~ends[:-1] & ends[1:]
        ends[offsets[1:][sizes > 0] - 1] = True
        ends = np.flatnonzero(ends)
        first = np.searchsorted(ends, offsets)
        tokens = np.diff(first)
        marked = set(_rows_of(marks_in(data), offsets).tolist())

        forms, a, b = [], offsets[:-1].copy(), offsets[:-1].copy()
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            one, two, cut, order = _draws(doc_id, seed)
            if sizes[k] == 0 or k in marked or cut % 100 >= rate:
                forms.append("plain")
                continue
            forms.append("spm" if order % 100 < suffix_first else "psm")
            n = int(tokens[k]) + 1
            low, high = sorted((one % n, two % n))
            a[k] = ends[first[k] + low - 1] + 1 if low else offsets[k]
            b[k] = ends[first[k] + high - 1] + 1 if high else offsets[k]
        form = np.array(forms)
        plain, spm = form == "plain", form == "spm"

        # plain texts are one suffix without marks
        out_size = sizes + np.where(plain, 0, 3 * MARK)
        at = np.concatenate([[0], np.cumsum(out_size)])[:-1]
        suffix = offsets[1:] - b
        to_suffix = at + np.where(plain, 0, np.where(spm, MARK, 2 * MARK + a - offsets[:-1]))
        to_prefix = at + np.where(spm, 2 * MARK + suffix, MARK)
        to_middle = at + 3 * MARK + (a - offsets[:-1]) + suffix
        starts = np.stack([offsets[:-1], a, b], 1).ravel()
        moved = np.stack([to_prefix, to_middle, to_suffix], 1).ravel() - starts
        out = np.empty(int(out_size.sum()), np.uint8)
        for here, there in shifts(len(data), starts, moved):
            out[there] = data[here]
        for mark, place in ((PREFIX, to_prefix - MARK), (SUFFIX, to_suffix - MARK), (MIDDLE, to_middle - MARK)):
            out[place[~plain][:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)

        leads = (data & 0xC0) != 0x80  # first bytes of characters
        chars = [[None if p else int(np.count_nonzero(leads[i:j])) for p, i, j in zip(plain, low, high, strict=True)] for low, high in ((offsets[:-1], a), (a, b))]
        columns = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(forms, pa.string()), *(pa.array(c, pa.int64()) for c in chars), _column(pa.string(), out, out_size)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield of_batch(batch)

    return run


def _restore(carried: int):
    """The last two columns are output, form; those before them are carried."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _bytes_of(batch.column(carried))
        form = np.array([f or "" for f in batch.column(carried + 1).to_pylist()])
        places = marks_in(data)
        row = _rows_of(places, offsets)
        places, row = places[row >= 0], row[row >= 0]
        cut = np.isin(form, ("psm", "spm"))
        letters = np.zeros(len(form), "U3")
        found = np.bincount(row, minlength=len(form))
        where = np.zeros((len(form), 3), np.int64)
        starts = np.cumsum(found) - found
        for k in np.flatnonzero(cut & (found == 3)):
            where[k] = places[starts[k] : starts[k] + 3]
            letters[k] = "".join(map(chr, data[where[k] + 1]))
        whole = (where[:, 0] == offsets[:-1]) & (((form == "psm") & (letters == "PSM")) | ((form == "spm") & (letters == "SPM")))
        valid = whole | (form == "plain")

        size = np.where(valid, np.diff(offsets) - np.where(whole, 3 * MARK, 0), 0)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        spm = form == "spm"
        one, two = where[:, 1] - where[:, 0] - MARK, where[:, 2] - where[:, 1] - MARK
        from_one, from_two = where[:, 0] + MARK, where[:, 1] + MARK
        prefix, from_prefix = np.where(spm, two, one), np.where(spm, from_two, from_one)
        suffix, from_suffix = np.where(spm, one, two), np.where(spm, from_one, from_two)
        # a plain output is one prefix
        prefix, from_prefix = np.where(whole, prefix, size), np.where(whole, from_prefix, offsets[:-1])
        suffix = np.where(whole, suffix, 0)
        starts = np.stack([at, at + prefix, at + size - suffix], 1)
        moved = np.stack([from_prefix, where[:, 2] + MARK, from_suffix], 1) - starts
        text = np.empty(int(size.sum()), np.uint8)
        for here, there in shifts(len(text), starts[valid].ravel(), moved[valid].ravel()):
            text[here] = data[there]
        columns = [*batch.columns[:carried], _column(pa.string(), text, size, valid)]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:carried], "restored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield of_batch(batch)

    return run


def fill_in_middle(docs: DataFrame, *, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts texts at two tokens and puts the middle last.

    A token is a run of other characters with the spaces before it, or the spaces that end
    a text. Returns per row doc_id, n (tokens), form (plain, psm or spm), prefix_chars and
    middle_chars (code points, null if plain) and output. Null texts count as empty; empty
    texts and those that hold a mark stay plain. Rows are worked on alone: rows that repeat
    an id and a text give equal rows, and a null id draws as the seed without an id. Other
    columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("raw")), _transform(seed, rate, suffix_first), OUTPUTS)


def restore(outputs: DataFrame) -> DataFrame:
    """Replaces columns output and form by restored, the text before it was cut; null where the marks aren't as form says. Other columns stay."""
    kept = [c for c in outputs.columns if c not in ("output", "form", "restored")]
    quoted = [F.col(f"`{c}`") for c in kept]
    schema = ", ".join(f"`{c}` {t}" for c, t in outputs.select(*quoted).dtypes)
    raw = F.coalesce(F.col("output"), F.lit("")).cast("binary").alias("raw")
    return map_arrow(outputs.select(*quoted, raw, "form"), _restore(len(kept)), f"{schema}{', ' if kept else ''}restored string")
