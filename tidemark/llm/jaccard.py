"""Similarity join of word-shingle sets by filtering under several global token orders.

Of two sets with a Jaccard similarity of t or more, each has among its first
n - ceil(t n) + 1 tokens, under any total order of all tokens, one that the other has
there too. The orders used here put rare tokens first (by a count sketch of all
documents) and differ in how equally frequent tokens follow each other. Documents with
equal sets are one node.

Candidates: one pass over the texts counts the front tokens of all orders; a bounded bit
filter of those counted twice tells a second pass which front tokens may be shared. A
node without shared front tokens under each of the orders has no partner. Nodes with a
common token under the first order, of like sizes, form a bucket; buckets with equal
members are one. Inside a bucket a pair is a candidate if it also has a common token
under each further order, and if a short profile of both sets (token counts by hash
bucket) doesn't rule it out. A bucket emits only a forest that ties its candidates
together, so what it emits never grows with the square of its members. Larger buckets
are cut, and every two cuts meet.

Verification: candidates' components are families. Whole sets are made anew for members
of families only, and all pairs of a family are compared exactly, block by block; a block
emits the number of each member's links and a forest of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, map_arrow, partitions, stash, text_steps
from tidemark.llm.components import Forest, connected_components
from tidemark.llm.grams import BASE, mix
from tidemark.llm.repeats import key_filter, may_hold

WORDS, PERCENT = 5, 75
#: Seeds of the token orders; the first makes buckets.
ORDERS = (0x51ED270B, 0x2545F491, 0x9E6C63D0)
#: Counters of the frequency sketch, and the blocks that it is summed in.
SKETCH, SKETCH_BLOCKS = 1 << 22, 512
#: Nodes to a cut of a bucket or family, and tokens to a cut of a family (whole sets) and of a bucket (profiles), on average.
CUT_NODES, CUT_TOKENS, PROFILE_TOKENS = 2048, 1 << 20, 1 << 25
#: Tokens with more holders in a block are columns of a product, so many at once; rows of overlaps judged at once.
FEW_HOLDERS, COLUMNS, TILE = 8, 1024, 256
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted 64-bit hashes of its distinct shingles of lower-cased (A-Z) words."""
    split = [(t or "").encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    raw = np.frombuffer(b" ".join(w for ws in split for w in ws) + b" ", np.uint8)
    if not counts.sum():
        return [np.zeros(0, np.uint64)] * len(texts)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    ends = np.flatnonzero(raw == 32)
    starts = np.append(0, ends[:-1] + 1)
    out, at = [], 0
    for n in counts.tolist():
        k = max(1, n - words + 1) if n else 0
        a, b = starts[at : at + k], ends[at + min(n, words) - 1 : at + n] if n else ends[:0]
        out.append(np.unique(mix((sums[b] - sums[a]) * down[a])))
        at += n
    return out


def name_of(hashes: np.ndarray) -> bytes:
    """Names a set: 128 bits of a digest of its sorted hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def in_front(hashes: np.ndarray, rarity: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """Which tokens of a set are among its first n - ceil(t n) + 1 under one order."""
    n, out = len(hashes), np.ones(len(hashes), bool)
    keep = n + (-percent * n) // 100 + 1
    if keep < n:
        rank = (rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (mix(hashes ^ np.uint64(seed)) >> np.uint64(6))
        out[np.argpartition(rank, keep - 1)[keep:]] = False
    return out


def _distinct_sets(batch: pa.RecordBatch, column: int, words: int) -> Iterator[np.ndarray]:
    """Sets of a batch's distinct texts, empty ones left out."""
    texts = list(dict.fromkeys(t for t in batch.column(column).to_pylist() if t))
    for i, j in text_steps(texts):
        yield from (s for s in shingle_sets(texts[i:j], words) if len(s))


SURVEYED = "doc_id long, name binary, n int, block int, counts binary"


def _survey(words: int):
    """Per document its set's name and size; per task, at its end, its sketch of token frequencies."""
    names = [x.split(" ")[0] for x in SURVEYED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for i, j in text_steps(texts):
                sets = shingle_sets(texts[i:j], words)
                called = [name_of(s) if len(s) else None for s in sets]
                fresh = [s for s, x in zip(sets, called, strict=True) if x is not None and x not in seen]
                seen = set() if len(seen) > 500_000 else seen
                seen.update(called)
                if fresh:
                    at, n = np.unique((np.concatenate(fresh) & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
                    sketch[at] += n.astype(np.uint32)
                k = j - i
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(called, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        squeeze, k = zstandard.ZstdCompressor(level=1), SKETCH_BLOCKS
        parts = [squeeze.compress(p.astype("<u4").tobytes()) for p in np.array_split(sketch, k)]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base-2 logarithms of the summed counters of each block that a task holds."""
    plain, total = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(plain.decompress(counts), "<u4")
            total[block] = total.get(block, 0) + part.astype(np.int64)
    if total:
        logs = [np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], names=["block", "logs"])


def _rarity(surveyed: DataFrame) -> np.ndarray:
    parts = surveyed.filter("block is not null").select("block", "counts").repartition(min(SKETCH_BLOCKS, partitions(surveyed.sparkSession)), "block")
    rows = map_arrow(parts, _add_counts, "block int, logs binary").collect()  # a byte for each counter
    return np.concatenate([np.frombuffer(r["logs"], np.uint8) for r in sorted(rows)]) if rows else np.zeros(SKETCH, np.uint8)


def _count_fronts(words: int, rarity: np.ndarray, percent: int):
    """Tokens that are in front under any of the orders, with the distinct texts of each batch that have them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for s in _distinct_sets(batch, 0, words):
                held.append(s[np.logical_or.reduce([in_front(s, rarity, o, percent) for o in ORDERS])])
                if sum(map(len, held)) > 1_000_000:
                    yield _counted(held)
                    held = []
            if held:
                yield _counted(held)

    return run


def _counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(tokens).view(np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["token", "n"])


def profile_sizes(n: np.ndarray) -> np.ndarray:
    """Buckets of the profile of sets with n tokens: a power of two, about n / 4."""
    return 1 << np.maximum(4, np.frexp(n // 4)[1] - 1)


def profile(hashes: np.ndarray) -> bytes:
    """How many tokens of a set fall to each of some hash buckets, one byte each; more buckets where a byte is too small."""
    buckets = int(profile_sizes(np.array(len(hashes))))
    while True:
        counts = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        buckets *= 2


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts by fewer buckets, both numbers powers of two."""
    return counts.reshape(-1, size).sum(0, dtype=np.uint16)


def short_names(tokens: np.ndarray) -> bytes:
    """Two bytes for each token; like tokens have like names, and a few others too."""
    return np.unique((tokens >> np.uint64(40)).astype("<u2")).tobytes()


NODES = "name binary, n int, profile binary, tokens array<long>, second binary, third binary"


def _shared_fronts(words: int, rarity: np.ndarray, percent: int, bits: np.ndarray):
    """Of sets that may share a front token under each order: those tokens, and the profile."""
    kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    names = [x.split(" ")[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in _distinct_sets(batch, 0, words):
                shared = may_hold(bits, s)
                fronts = [s[shared & in_front(s, rarity, o, percent)] for o in ORDERS]
                if all(map(len, fronts)):
                    rows.append((name_of(s), len(s), profile(s), fronts[0].view(np.int64), *(short_names(f) for f in fronts[1:])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def blocks_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each block, from rows sorted by block in the first columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def tie_candidates(rows: list[tuple], across: bool, percent: int) -> list[tuple[int, int]]:
    """A forest of the candidates among rows of (cut, native, node, n, profile, second, third); across: only pairs of different cuts.

    Two rows that aren't native to the bucket are a matter of another one.
    """
    rows = sorted(rows, key=lambda r: r[3])
    n, cut, native = (np.array([r[k] for r in rows]) for k in (3, 0, 1))
    counts = [np.frombuffer(r[4], np.uint8) for r in rows]
    fronts: list[list[frozenset | None]] = [[None] * len(rows), [None] * len(rows)]
    forest, out = Forest(len(rows)), []

    def shares(i: int, j: int) -> bool:
        for k, front in enumerate(fronts):
            for x in (i, j):
                if front[x] is None:
                    front[x] = frozenset(np.frombuffer(rows[x][5 + k], "<u2").tolist())
            if front[i].isdisjoint(front[j]):
                return False
        return True

    last, sizes, base, table = np.searchsorted(n, 100 * n // percent, "right"), profile_sizes(n), 0, None
    for i in range(len(rows) - 1):
        if table is None or table.shape[1] != sizes[i]:  # the rows from here on that rows with as many buckets may meet
            base, stop = i, last[np.searchsorted(sizes, sizes[i], "right") - 1]
            table = np.stack([folded(c, sizes[i]) for c in counts[base:stop]])
        j = np.arange(i + 1, last[i])
        j = j[(native[j] | native[i]) & (forest.label[j] != forest.label[i]) & ((cut[j] != cut[i]) | (not across))]
        most = np.minimum(table[j - base], table[i - base]).sum(1, dtype=np.int64)
        near = j[100 * most >= percent * (n[i] + n[j] - most)]
        out += [(rows[a][2], rows[b][2]) for a, b in forest.joined(i, near, shares)]
    return out


def _tie(percent: int):
    """Rows come sorted by token, class, low and high cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for rows in blocks_of(batches, 4):
            held += tie_candidates([r[4:] for r in rows], rows[0][2] != rows[0][3], percent)
            if len(held) > 10_000:
                yield _pairs(held)
                held = []
        yield _pairs(held)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


SETS = "name binary, hashes binary"


def _sets_of(words: int, bits: np.ndarray):
    """The whole sets of documents without an id, or with one that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            wanted = may_hold(bits, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) | ids.is_null().to_numpy(zero_copy_only=False)
            sets = list(_distinct_sets(batch.filter(pa.array(wanted)), 1, words))
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "hashes"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, as floats (exact below 2^24).

    Tokens that many sets have are multiplied as columns of zeros and ones, the others
    counted by their holders.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    out = np.zeros((m, m), np.float32)
    row, token = np.repeat(np.arange(m), sizes), np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    held = np.diff(np.append(start, len(token)))
    column, often = np.repeat(np.arange(len(start)), held), held > FEW_HOLDERS
    hot_column, hot_row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(hot_column, (first, first + COLUMNS))
        part = np.zeros((m, COLUMNS), np.float32)
        part[hot_row[a:b], hot_column[a:b] - first] = 1
        out += part @ part.T
    cold = ((held > 1) & ~often)[column]
    row, column = row[cold], column[cold]
    for step in range(1, FEW_HOLDERS):  # every two holders, at each distance in the sorted list
        same = np.flatnonzero(column[step:] == column[:-step])
        np.add.at(out, (row[same], row[same + step]), 1)
        np.add.at(out, (row[same + step], row[same]), 1)
    out[np.arange(m), np.arange(m)] = sizes
    return out


def exact_links(rows: list[tuple], across: bool, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of rows (cut, node, copies, hashes): a forest of the links, and how many documents each row's node is linked with here."""
    cut, node, copies = (np.array([r[k] for r in rows]) for k in range(3))
    sets = [np.frombuffer(r[3], "<u8") for r in rows]
    n, forest, out, links = np.array([len(s) for s in sets]), Forest(len(rows)), [], []
    held = overlaps(sets)
    for i in range(0, len(rows), TILE):
        common = held[i : i + TILE].astype(np.int64)
        k = len(common)
        linked = 100 * common >= percent * (n[i : i + k, None] + n - common)
        linked[np.arange(k), np.arange(i, i + k)] = False
        if across:  # pairs inside a cut are counted where the cut meets itself
            linked &= cut[i : i + k, None] != cut
        links.append(linked @ copies)
        for r in np.flatnonzero(linked.any(1)).tolist():
            out += [(node[a], node[b]) for a, b in forest.joined(i + r, np.flatnonzero(linked[r]))]
    return out, np.concatenate(links)


LINKS = "a long, b long, links long"


def _link(percent: int):
    """Rows come sorted by family, low and high cut; gives forest edges (a, b), and (a, null, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks_of(batches, 3):
            edges, links = exact_links([r[3:] for r in rows], rows[0][1] != rows[0][2], percent)
            some = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([e[0] for e in edges] + [rows[k][4] for k in some], pa.int64()), pa.array([e[1] for e in edges] + [None] * len(some), pa.int64()),
                    pa.array([None] * len(edges) + links[some].tolist(), pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    return run


def _every_two_cuts(rows: DataFrame, name: str) -> DataFrame:
    """Deals rows with a number of cuts to blocks (low, high): one block where there is one cut, else every two cuts meet in one."""
    cut = rows.withColumn("cut", F.pmod(F.xxhash64(name), F.col("cuts")).cast("int"))
    other = F.explode(F.when(F.col("cuts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))).alias("other")
    return cut.select("*", other).withColumns({"low": F.least("cut", "other"), "high": F.greatest("cut", "other")}).drop("other", "cuts")


def similar_sets(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    Returns per document doc_id, n_shingles, component_id, the smallest doc_id that links
    reach, and n_links, the number of other documents linked with it directly. With fewer
    words than a shingle the whole sequence is the only one; null texts and texts without
    words have none and link with nothing. Rows that repeat a doc_id are treated as
    documents each, as are those without one; a component of only such has no id. Other
    columns are not read. An empty table gives no rows.
    """
    docs = documents(docs, id_col, text_col)
    spark = docs.sparkSession
    surveyed = stash(map_arrow(docs, _survey(words), SURVEYED), "shingle-survey")
    rarity = _rarity(surveyed)
    sizes = surveyed.filter("block is null").select("doc_id", "name", "n")
    grouped = sizes.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    nodes = stash(grouped.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")

    fronts = map_arrow(docs.select("text"), _count_fronts(words, rarity, percent), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    shared = stash(fronts.filter("n > 1").select("token"), "shared-tokens")
    bits = key_filter(shared, "token", shared.count())
    held = stash(map_arrow(docs.select("text"), _shared_fronts(words, rarity, percent, bits), NODES), "shared-sets")
    fronts = held.select("name", "n", "tokens").dropDuplicates(["name"]).join(nodes.select("name", "node"), "name")

    # Tokens that the same sets have in front are one; among few postings, buckets are then made by
    # class of sizes: two sets of like sizes are in one class or in neighbouring ones.
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1.005 * 100 / percent)).cast("int")
    own = fronts.select("node", "n", size_class.alias("own"), F.explode("tokens").alias("token"))
    postings = own.groupBy("token").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("held > 1")
    unlike = stash(postings.groupBy("held", "x", "y").agg(F.min("token").alias("token")).select("token"), "shingle-postings")
    classes = F.explode(F.array("own", F.col("own") + 1)).alias("class")
    dealt = stash(own.join(unlike, "token").select("token", "node", "n", classes, "own").withColumn("native", F.col("own") == F.col("class")).drop("own"), "shingle-members")
    members = dealt.groupBy("token", "class").agg(F.count("*").alias("held"), F.sum("n").alias("tokens"), F.count_if("native").alias("natives")).filter("held > 1 and natives > 0")
    cuts = F.greatest(F.ceil(F.col("held") / CUT_NODES), F.ceil(F.col("tokens") / PROFILE_TOKENS)).cast("int")
    buckets = stash(members.select("token", "class", cuts.alias("cuts")), "shingle-buckets")
    met = _every_two_cuts(dealt.join(buckets, ["token", "class"]), "node").join(nodes.select("node", "name"), "node")
    met = met.join(held.select("name", "profile", "second", "third").dropDuplicates(["name"]), "name")
    keys = ["token", "class", "low", "high"]
    met = met.select(*keys, "cut", "native", "node", "n", "profile", "second", "third").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    ties = stash(map_arrow(met, _tie(percent), "a long, b long"), "candidate-ties")

    # Families: the candidates' components; whole sets are made anew for their members.
    family = stash(connected_components(ties).join(nodes, "node"), "families")
    large = family.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CUT_NODES), F.ceil(F.sum("n") / CUT_TOKENS)).cast("int").alias("cuts"))
    named = family.select("root", "node", "name", "copies").join(large, "root")
    ids = key_filter(family.filter("doc_id is not null"), "doc_id", family.count())
    sets = map_arrow(docs, _sets_of(words, ids), SETS).join(named, "name").dropDuplicates(["name"])
    keys = ["root", "low", "high"]
    met = _every_two_cuts(sets, "node").select(*keys, "cut", "node", "copies", "hashes").repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    linked = stash(map_arrow(met, _link(percent), LINKS), "shingle-links")

    roots = stash(connected_components(linked.filter("b is not null").select("a", "b")).join(nodes.select("node", "doc_id"), "node"), "link-roots")
    labels = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    counts = linked.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    told = roots.select("node", "root").join(labels, "root").join(counts, "node")
    told = stash(nodes.select("name", "node", "doc_id", "copies").join(told, "node", "left").select("name", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "set-results")
    return sizes.join(told, "name", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
