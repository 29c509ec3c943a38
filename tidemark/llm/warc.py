"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payloads are grouped by digest; the row with the smallest page_id of a group
is a response, the others are revisits of it. Records are built by column functions and
written as plain text files whose line separator is the blank lines that end a WARC
record, so that Spark's own commit protects them and byte ranges can be read apart.

Reading: the version magic may also stand inside a payload. Spark's text reader deals
archives out by byte range and cuts them at every magic. Each task emits every place of
its range that looks like a record, with the offset of its successor (header length plus
Content-Length), and how long the range is; running sums of these lengths turn places in
a range into offsets in the file. Inside a range, successors are followed to the first
offset beyond it; pointer jumping over these exits, whose span doubles each round, from
the start of each file tells the entry of every range; each range then keeps the records
on the chain from its entry. Whatever no chain reaches is payload. A payload with a magic
inside is digested in a second pass over the ranges that hold it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, partitions, stash

END = "\r\n\r\n"
#: Every record starts with this, followed by 0 or 1 and a line end.
MAGIC = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(text), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, compression: str = "none", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row, one archive for each partition of the input. A null payload is empty; a null id or URL leaves an empty field.

    Payloads of fewer than min_revisit_bytes are always responses. Rows that repeat the
    smallest id of a group are responses too, as are rows without an id. White space in a
    URL, and the first letter of the version magic there, are percent-encoded. An empty
    table leaves files without records. Other columns are not read. With compression
    "gzip" an archive is read by one task.
    """
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), r"\s", "%20"), r"WARC/1\.", "%57ARC/1.")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    digest = base32_sha1(F.encode("payload", "UTF-8"))
    known = stash(rows.select("page_id", digest.alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    groups = known.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = stash(groups.filter("n > 1"), "warc-groups").select("digest", "bytes", "first")
    revisits = stash(known.join(shared, ["digest", "bytes"]).filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    held = rows.withColumn("digest", digest).join(revisits, ["page_id", "digest"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    is_new, size = F.col("refers_to").isNull(), F.octet_length("payload").cast("string")
    header = F.concat(
        F.lit(MAGIC + "0\r\nWARC-Type: "), F.when(is_new, "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nPayload-Length: "), size,
        F.when(is_new, "").otherwise(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("refers_to")))),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(is_new, size).otherwise("0"), F.lit(END),
    )
    held.select(F.concat(header, F.when(is_new, F.col("payload")).otherwise("")).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _number(field: bytes | None) -> int | None:
    """The number at the end of a record's name, if it is one of 64 bits."""
    m = re.search(rb"(-?\d{1,19})>$", field or b"")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def _size(field: bytes | None) -> int | None:
    return int(field) if field and field.isdigit() and len(field) <= 18 else None


def parse_header(fields: dict[bytes, bytes]) -> tuple | None:
    """(content bytes, page_id, payload_bytes, payload_digest, record_type, refers_to) of what may be a record's header; None if it can't be.

    The size and digest of a response are those of its content: the digest is None here.
    """
    content, kind = _size(fields.get(b"content-length")), fields.get(b"warc-type", b"").decode("utf-8", "replace")
    size, digest = content, None
    if kind == "revisit":
        size, digest = _size(fields.get(b"payload-length", b"0")), fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    if content is None or size is None:
        return None
    return content, _number(fields.get(b"warc-record-id")), size, digest, kind, _number(fields.get(b"warc-refers-to"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class Range:
    """The candidates of one byte range, from its pieces between magics in order; places count from the range's first piece.

    A header may hold the magic too and span pieces: those without a blank line wait for
    it, and places before the same blank line share the fields after them.
    """

    def __init__(self, at_start: bool):
        self.length, self.waiting, self.candidates, self.bare = 0, [], [], at_start

    def add(self, piece: bytes) -> None:
        text = piece if self.bare else MAGIC.encode() + piece
        self.bare = False
        if not text:  # the file starts with a magic
            return
        self.waiting.append((self.length, text))
        self.length += len(text)
        blank = piece.find(END.encode())
        if blank < 0:
            return
        cut, fields, rest = blank + len(text) - len(piece), {}, b""
        payload_at = self.length - len(text) + cut + len(END)
        for k, (at, held) in enumerate(reversed(self.waiting)):
            head = (held[:cut] if k == 0 else held) + rest
            # a magic inside a line leaves the part of that line before it to the place before
            first, *lines = head.split(b"\r\n")
            starts = first in (b"WARC/1.0", b"WARC/1.1")
            for line in reversed(lines):
                name, _, value = line.partition(b":")
                fields[name.strip().lower()] = value.strip()
            rest = first
            if starts and (found := parse_header(fields)):
                inside = text[cut + len(END) : cut + len(END) + found[0]]
                digest = found[3] if found[3] is not None else base32(hashlib.sha1(inside).digest()) if len(inside) == found[0] else None
                self.candidates.append([at, payload_at + found[0] + len(END), payload_at, *found[1:3], digest, *found[4:]])
        self.waiting = []

    def rows(self) -> list[list]:
        """(place, successor, exit, payload_at, ...); exit: the first place beyond the range that the chain leads to, None where it breaks off."""
        exits: dict[int, int | None] = {}
        for c in sorted(self.candidates, reverse=True, key=lambda c: c[0]):
            exits[c[0]] = exits.get(c[1]) if c[1] < self.length else c[1]
        return [[c[0], c[1], exits[c[0]], *c[2:]] for c in self.candidates]


SCANNED = "file string, start long, length long, place long, next long, exit long, payload_at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _arrow(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(columns), columns, strict=True)], names=[n for n, _ in columns])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """((file, start), pieces) of each range, one after another."""
    rows = ((*key, piece) for b in batches for *key, piece in zip(*(c.to_pylist() for c in b.columns), strict=True))
    from itertools import groupby

    for key, group in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in group)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), pieces in _ranges(batches):
        held = Range(start == 0)
        for piece in pieces:
            held.add(piece)
        empty = [None] * 9
        yield _arrow([[file, start, held.length, *empty], *([file, start, None, *r] for r in held.rows())], SCANNED)


PIECES = "file string, start long, place long, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), pieces in _ranges(batches):
        at, bare = 0, start == 0
        for piece in pieces:
            text = piece if bare else MAGIC.encode() + piece
            bare = False
            yield _arrow([[file, start, at, text]], PIECES)
            at += len(text)


DIGESTED = "file string, offset long, payload_digest string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (file, record's offset, payload's first and last place in the file, a piece's place, its bytes) in order."""
    key, sha = None, None
    for batch in batches:
        for file, offset, first, last, at, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, offset) != key:
                if sha:
                    yield _arrow([[*key, base32(sha.digest())]], DIGESTED)
                key, sha = (file, offset), hashlib.sha1()
            sha.update(piece[max(0, first - at) : max(0, last - at)])
    if sha:
        yield _arrow([[*key, base32(sha.digest())]], DIGESTED)


KEPT = "file string, offset long"


def _keep_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (file, start, offset, successor, entry) come sorted by range and offset: those on the chain from the range's entry."""
    key, at = None, None
    for batch in batches:
        kept = []
        for file, start, offset, after, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != key:
                key, at = (file, start), None
            if entry and at is None or offset == at:
                kept.append([file, offset])
                at = after
        yield _arrow(kept, KEPT)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives (plain or gzip-compressed) under path, with their payloads' sizes and digests as read.

    An archive whose records don't follow each other up to its end is an error; a place
    that looks like a record but has broken fields is payload.
    """
    archive = spark.read.option("lineSep", MAGIC).text(path)
    pieces = archive.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    scanned = stash(map_arrow(pieces, _scan, SCANNED), "warc-scan")
    before = Window.partitionBy("file").orderBy("start")
    ranges = scanned.filter("length is not null").select("file", "start", "length", (F.sum("length").over(before) - F.col("length")).alias("base"))
    ranges = stash(ranges, "warc-ranges")
    shift = lambda c: (F.col(c) + F.col("base")).alias("offset" if c == "place" else c)
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = stash(scanned.filter("length is null").drop("length").join(ranges, ["file", "start"]).select("file", "start", *map(shift, ("place", "next", "exit", "payload_at")), *fields), "warc-candidates")

    starts = ranges.filter("length > 0").select("file", F.lit(0).cast("long").alias("offset")).distinct()
    places = found.filter("exit is not null").select("file", F.col("exit").alias("offset")).union(starts).distinct()
    jumps = stash(places.join(found, ["file", "offset"]).select("file", "offset", F.col("exit").alias("to")), "warc-jumps")
    entries, n = stash(starts, "warc-entries"), -1
    while (now := entries.count()) != n:
        n = now
        ahead = entries.join(jumps.filter("to is not null"), ["file", "offset"]).select("file", F.col("to").alias("offset"))
        entries = stash(entries.union(ahead.join(jumps.select("file", "offset"), ["file", "offset"])).distinct(), "warc-entries")
        far = jumps.alias("a").join(jumps.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.offset")), "left")
        jumps = stash(far.select("a.file", "a.offset", F.col("b.to").alias("to")), "warc-jumps")
    flagged = found.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left").select("file", "start", "offset", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    in_order = flagged.repartition(partitions(spark), "file", "start").sortWithinPartitions("file", "start", "offset")
    kept = stash(found.join(map_arrow(in_order, _keep_chain, KEPT), ["file", "offset"]), "warc-records")
    reached = kept.groupBy("file").agg(F.max("next").alias("reached"))
    broken = ranges.filter("length > 0").groupBy("file").agg(F.sum("length").alias("bytes")).join(reached, "file", "left").filter("not reached <=> bytes").first()
    if broken:
        raise ValueError(f"{broken['file']}: no whole record at byte {broken['reached'] or 0} of {broken['bytes']}")

    # Payloads that a magic cuts: their pieces, from all ranges that they reach into.
    cut = kept.filter("payload_digest is null").select("file", "offset", "payload_at", (F.col("next") - len(END)).alias("last"))
    if cut.isEmpty():
        return kept.select(*fields)
    spread = cut.join(ranges, "file").filter("base < last and base + length > payload_at").select("file", "start", "base", "offset", "payload_at", "last")
    parts = map_arrow(pieces, _pieces, PIECES).join(spread, ["file", "start"]).withColumn("at", F.col("place") + F.col("base")).filter("at < last and at + octet_length(bytes) > payload_at")
    in_order = parts.select("file", "offset", "payload_at", "last", "at", "bytes").repartition(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset", "at")
    digests = map_arrow(in_order, _digest, DIGESTED).withColumnRenamed("payload_digest", "whole")
    return kept.join(digests, ["file", "offset"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "whole")).select(*fields)
