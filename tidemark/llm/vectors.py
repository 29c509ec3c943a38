"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by a random rotation and coded by the signs of its coordinates,
with one correction factor, the inner product of the code and the turned vector. For
another turned vector q, <code, q> / factor estimates the inner product without bias, and
its error stays within a few times sqrt((1 - factor^2) / factor^2 / (d - 1)).

A first pass only gathers components early: sign bits deal vectors into buckets of several
tables, every vector proposes the best-estimated partner of its bucket, and proposals are
recomputed exactly in double precision. What it misses is left to the second pass, which
compares the codes of all vectors of a length with each other, block by block. There a pair
across components is settled only by bounds that always hold: the angle between two
vectors is at least that between the one's code and the other less that between the one and
its own code, with what rounding moved added to the slack; coordinates rounded to 16 bits
then bound the product from both sides, some hundred-thousandths apart. Pairs that are sure
to be links join their components in the block, which gives a forest of them and never all
pairs of a group; only pairs between the bounds are recomputed exactly. Links are counted
last, by exact products of blocks inside each component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, partitions, stash
from tidemark.llm.components import connected_components

THRESHOLD = 0.95
#: Expected share of pairs at the threshold that meet in a bucket of the first pass; the second pass meets all pairs.
RECALL = 0.995
#: Vectors to a bucket on average, and to a block of a bucket or component.
BUCKET, BLOCK = 64, 2048
#: Vectors to a cut of the second pass, at most, and cuts that a smaller table is dealt to; rows compared at once.
CUT, CUTS, TILE = 32_768, 12, 512
#: Standard deviations of the estimate's error that a bound allows for.
DEVIATIONS = 4.0
SEED = 11
#: Coordinates are rounded to whole numbers up to this.
LEVELS = 32_767

UNITS = "vec_id long, dim int, same string, unit binary"
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of this dimension."""
    if (dim, k) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng((SEED, dim, k)).normal(size=(dim, dim)))
        _ROTATIONS[dim, k] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, k]


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, same, units = [], [], []
        for v in batch.column(1).to_pylist():
            x = np.array([] if v is None or None in v else v, float)
            with np.errstate(all="ignore"):
                size = float(np.linalg.norm(x / (np.abs(x).max() or 1))) if len(x) and np.isfinite(x).all() else 0.0
            if size > 0:
                u = x / np.abs(x).max() / size
                dims.append(len(u))
                same.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
                units.append(u.tobytes())
            else:
                dims.append(None), same.append(None), units.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(same, pa.string()), pa.array(units, pa.binary())], names=["vec_id", "dim", "same", "unit"])


def tables_for(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket and number of tables."""
    bits = max(4, math.ceil(math.log2(max(2, count) / BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


CODES = "node long, buckets array<long>, signs binary, factor double, scale double, levels binary, error double"


def _code(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows = []
            for node, dim, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u = np.frombuffer(unit, "<f8")
                turned = u @ rotation(dim, 0)
                more = [u @ rotation(dim, k) for k in range(1, -(-bits * tables // dim) + 1)]
                on = (np.concatenate(more) > 0)[: bits * tables].reshape(tables, bits)
                buckets = (np.arange(tables) + tables * dim << bits) + on @ weights
                code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
                scale = np.abs(turned).max() / LEVELS
                # randomised rounding keeps the estimate free of bias
                levels = np.floor(turned / scale + np.random.default_rng((SEED, node & (1 << 63) - 1)).random(dim)).clip(-LEVELS - 1, LEVELS).astype(np.int16)
                error = float(np.linalg.norm(turned - levels * scale))
                rows.append((node, buckets, np.packbits(turned > 0).tobytes(), float(code @ turned), float(scale), levels.tobytes(), error))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "buckets", "signs", "factor", "scale", "levels", "error"])

    return run


def upper_bounds(signs: list[bytes], factor: np.ndarray, scale: np.ndarray, levels: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of all pairs, rows as codes and columns as turned vectors, and their upper bounds."""
    turned = np.frombuffer(b"".join(levels), np.int16).reshape(len(levels), -1) * scale[:, None]
    dim = turned.shape[1]
    code = np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1), axis=1, count=dim) * 2.0 - 1
    estimate = code @ turned.T / math.sqrt(dim) / factor[:, None]
    slack = DEVIATIONS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, dim - 1))
    return estimate, estimate + slack[:, None]


def _propose(threshold: float):
    """Rows come sorted by block; each vector's best partner."""

    def of_block(rows: list[tuple]) -> np.ndarray:
        if len(rows) < 2:
            return np.zeros((0, 2), np.int64)
        factor, scale = (np.array([r[i] for r in rows]) for i in (3, 4))
        estimate, upper = upper_bounds([r[2] for r in rows], factor, scale, [r[5] for r in rows])
        near = (upper >= threshold) & (upper.T >= threshold)
        np.fill_diagonal(near, False)
        node = np.array([r[1] for r in rows])
        a = np.flatnonzero(near.any(1))
        b = np.where(near, estimate, -np.inf)[a].argmax(1)
        return np.stack([node[a], node[b]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            yield _as_pairs(of_block(rows))

    return run


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block, from rows sorted by block in the first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _as_pairs(found: np.ndarray) -> pa.RecordBatch:
    found = np.sort(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


class Parts:
    """Components of a block's rows, by the number that each has already."""

    def __init__(self, *parts: np.ndarray):
        numbers = np.unique(np.concatenate(parts), return_inverse=True)[1]
        self.rows = np.split(numbers, np.cumsum([len(p) for p in parts])[:-1])
        self.root = np.arange(numbers.max(initial=-1) + 1)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the ties (roots a, b) that join two components, in order."""
        root, made = self.root.tolist(), []
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                made.append(k)
        self.root = np.array(root)
        while not np.array_equal(self.root, shorter := self.root[self.root]):
            self.root = shorter
        return np.array(made, np.int64)


def pairs_across(left: list[tuple], right: list[tuple] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different parts, of (node, part, signs, factor, scale, levels, error), right None: pairs within left: links that join two parts, one for each joining, and pairs that no bound decides."""
    theta = math.acos(min(1.0, max(-1.0, threshold)))

    def columns(rows: list[tuple]):
        node, part = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        factor, scale, error = (np.array([r[i] for r in rows]) for i in (3, 4, 6))
        levels = np.frombuffer(b"".join(r[5] for r in rows), np.int16).reshape(len(rows), -1)
        return node, part, factor, scale, error, levels

    node, part, factor, scale, error, levels = columns(left)
    node_r, part_r, _, scale_r, error_r, levels_r = columns(left if right is None else right)
    parts = Parts(part, part_r)
    own, own_r = parts.rows
    dim = levels.shape[1]
    code = np.unpackbits(np.frombuffer(b"".join(r[2] for r in left), np.uint8).reshape(len(left), -1), axis=1, count=dim) * np.float32(2) - 1
    code = np.column_stack([code, np.ones(len(left), np.float32)])
    # the last column adds what rounding may have taken from the product
    turned = np.column_stack([levels_r * (scale_r / math.sqrt(dim))[:, None], error_r]).astype(np.float32)
    rounding = (dim + 2) * 2.0**-23
    least = np.cos(np.minimum(math.pi, np.arccos(np.clip(factor, -1, 1)) + theta)) - rounding
    least = least.astype(np.float32) - np.float32(2.0**-23)
    for i in range(0, len(left), TILE):
        # within one cut, a tile meets only what stands after its first row
        first = i if right is None else 0
        near = code[i : i + TILE] @ turned[first:].T >= least[i : i + TILE, None]
        if 100 * np.count_nonzero(near) > near.size:
            near &= parts.root[own[i : i + TILE], None] != parts.root[own_r[first:]]
        a, b = np.nonzero(near)
        a, b = a + i, b + first
        if right is None:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 1 << 16):
            p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            apart = parts.root[own[p]] != parts.root[own_r[q]]
            p, q = p[apart], q[apart]
            product = np.einsum("ij,ij->i", levels[p].astype(float), levels_r[q].astype(float)) * scale[p] * scale_r[q]
            slack = error[p] + error_r[q] + error[p] * error_r[q] + rounding
            sure = np.flatnonzero(product - slack >= threshold)
            sure = sure[parts.join(parts.root[own[p[sure]]], parts.root[own_r[q[sure]]])]
            left_open = np.flatnonzero((product + slack >= threshold) & (product - slack < threshold))
            left_open = left_open[parts.root[own[p[left_open]]] != parts.root[own_r[q[left_open]]]]
            if len(sure) or len(left_open):
                yield tuple(np.stack([node[p[x]], node_r[q[x]]], 1) for x in (sure, left_open))


def _all_across(threshold: float):
    """Rows come sorted by block: (block, low, high, cut, then what pairs_across takes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            low, high = rows[0][1:3]
            left = [r[4:] for r in rows if r[3] == low]
            right = None if low == high else [r[4:] for r in rows if r[3] == high]
            if left and (right is None or right):
                for sure, left_open in pairs_across(left, right, threshold):
                    found = np.sort(np.concatenate([sure, left_open]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.arange(len(found)) < len(sure))], names=["a", "b", "sure"])

    return run


def _in_blocks(rows: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Adds column block: rows of a key that has up to size rows are one block; larger keys are cut, and every two cuts meet in a block."""
    cuts = stash(rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("cuts")).filter("cuts > 1"), "large-keys")
    cut = rows.join(cuts, key, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    met = cut.select("*", other).withColumn("low", F.least("cut", "other")).withColumn("high", F.greatest("cut", "other"))
    return met.withColumn("block", F.concat_ws("/", F.col(key), "low", "high")).drop("other", "cuts")


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(a, b) for a, b, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) if len(u) == len(v) and float(np.frombuffer(u, "<f8") @ np.frombuffer(v, "<f8")) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _count_links(threshold: float):
    """Rows come sorted by block; counts, for each vector of a block, those linked with it there."""

    def of_block(rows: list[tuple]) -> pa.RecordBatch:
        node, cut, copies = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
        u = np.frombuffer(b"".join(r[6] for r in rows), "<f8").reshape(len(rows), -1)
        linked = u @ u.T >= threshold
        np.fill_diagonal(linked, False)
        if rows[0][4] != rows[0][5]:  # pairs inside a cut are counted where the cut meets itself
            linked &= cut[:, None] != cut
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(linked @ copies)], names=["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(of_block, _blocks_of(batches))

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links vectors whose cosine is at least the threshold.

    Returns per row vec_id, n_links (other vectors linked with it), component_id (the
    smallest vec_id that links reach) and kept (it is that one). Vectors that are null,
    empty or zero, or hold a null or a component that isn't finite, link with nothing, nor do
    vectors of different lengths. Equal vectors are compared once and count for each other.
    Vectors are told apart by their components, not by their ids: rows that repeat an id, or
    have none, are vectors each. A component without any id has none. Other columns are not
    read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    units = stash(map_arrow(rows, _normalise, UNITS), "unit-vectors")
    nodes = units.filter("same is not null").groupBy("same").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    count = nodes.count()
    bits, tables = tables_for(count, threshold, recall)
    own = stash(units.filter("same is not null").join(nodes, "same").dropDuplicates(["same"]).select("node", "dim", "copies", "unit"), "node-vectors")
    codes = stash(map_arrow(own.select("node", "dim", "unit"), _code(bits, tables), CODES), "vector-codes")

    def confirmed(proposed: DataFrame) -> DataFrame:
        pairs = stash(proposed.distinct(), "vector-pairs")
        side = own.select("node", "unit")
        both = pairs.join(side.withColumnsRenamed({"node": "a", "unit": "u"}), "a").join(side.withColumnsRenamed({"node": "b", "unit": "v"}), "b")
        return stash(map_arrow(both.select("a", "b", "u", "v"), _exact(threshold), "a long, b long"), "vector-links")

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(spark), "block").sortWithinPartitions("block")

    dealt = codes.select("node", F.explode("buckets").alias("bucket"))
    mixed = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    placed = _in_blocks(stash(dealt.join(mixed, "bucket"), "dealt"), "bucket").join(codes.drop("buckets"), "node")
    links = confirmed(map_arrow(by_block(placed.select("block", "node", "signs", "factor", "scale", "levels")), _propose(threshold), "a long, b long"))

    parts = stash(connected_components(links), "vector-parts")
    parted = stash(own.select("node", "dim").join(parts, "node", "left").select("node", "dim", F.coalesce("root", "node").alias("part")), "vectors-of-parts")
    size = min(CUT, max(BLOCK, -(-count // CUTS)))
    met = _in_blocks(parted, "dim", size).join(codes.drop("buckets"), "node")
    met = by_block(met.select("block", "low", "high", "cut", "node", "part", "signs", "factor", "scale", "levels", "error"))
    across = stash(map_arrow(met, _all_across(threshold), "a long, b long, sure boolean"), "pairs-across")
    links = links.unionByName(across.filter("sure").select("a", "b")).unionByName(confirmed(across.filter("not sure").select("a", "b")))
    roots = stash(connected_components(links), "vector-roots")
    members = _in_blocks(stash(own.join(roots, "node").select("node", "root"), "members"), "root").join(own.select("node", "copies", "unit"), "node")
    in_order = members.select("block", "node", "cut", "copies", "low", "high", "unit").repartition(partitions(spark), "block").sortWithinPartitions("block")
    counted = map_arrow(in_order, _count_links(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    labels = nodes.join(roots, "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = stash(nodes.join(roots, "node", "left").join(labels, "root", "left").join(counted, "node", "left").select("same", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-results")
    out = units.select("vec_id", "same").join(told, "same", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
