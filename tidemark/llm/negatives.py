"""Hard negatives by Kronecker-packed products.

The components of many candidates are raised to be no less than zero and laid side by side
into one wide integer, a field each. An anchor's component times that integer is the
product with all of them at once; summed over the components, every field holds an inner
product. A constant keeps all fields at zero or more, so no field borrows from the next, and
unpacking gives exact scores. Fields are as many bytes wide as the largest possible sum of
the block needs.

Anchors and candidates are dealt to cuts by hash, and every two cuts meet in a block, so no
label, however common, has to fit in one task. A first pass gives each anchor its best
candidates of the same label, a second, with their scores known, the best of other labels
inside each positive's window; both keep what a block's best can contribute and merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.llm.common import stash

#: Candidates in one wide integer.
FIELDS = 2048
#: Rows of a cut, at most, and cuts that a smaller table of candidates is dealt to.
CUT, CUTS = 32_768, 24


class Packed:
    """Candidates of one dimension as wide integers."""

    def __init__(self, levels: np.ndarray, largest: int):
        """levels: (candidates, dimensions); largest: the largest absolute component of any anchor."""
        self.count, dim = levels.shape
        self.bias = int(np.abs(levels).max(initial=0))
        self.most = 2 * dim * self.bias * largest  # no sum of a field is larger
        self.width = max(1, -(-(2 * self.most).bit_length() // 8))
        raised = (levels + self.bias).astype("<u8").T
        self.wide, self.lift = [], []
        for i in range(0, self.count, FIELDS):
            part = np.ascontiguousarray(raised[:, i : i + FIELDS])
            fields = part.view(np.uint8).reshape(*part.shape, 8)[:, :, : self.width]
            self.wide.append([int.from_bytes(f.tobytes(), "little") for f in fields])
            self.lift.append(int.from_bytes(self.most.to_bytes(self.width, "little") * fields.shape[1], "little"))

    def scores(self, anchor: list[int], first: int, last: int) -> np.ndarray:
        """Inner products of the candidates from first to before last."""
        out = []
        low = first // FIELDS
        for k in range(low, -(-last // FIELDS)):
            total = self.lift[k]
            for a, wide in zip(anchor, self.wide[k], strict=True):
                total += a * wide
            n = min(FIELDS, self.count - k * FIELDS)
            fields = np.zeros((n, 8), np.uint8)
            fields[:, : self.width] = np.frombuffer(total.to_bytes(n * self.width, "little"), np.uint8).reshape(n, self.width)
            out.append(fields.view("<u8")[:, 0])
        if not out or first >= last:
            return np.zeros(0, np.int64)
        # what the bias and the lift added goes again, modulo 2 ** 64
        added = (self.most + self.bias * sum(anchor)) % (1 << 64)
        return (np.concatenate(out)[first - low * FIELDS : last - low * FIELDS] - np.uint64(added)).view(np.int64)


def best(scores: np.ndarray, rank: np.ndarray, count: int) -> np.ndarray:
    """Places of the largest scores, the smaller rank first among equals."""
    chosen = np.arange(len(scores))
    if len(scores) > count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        wanted = count - len(above)
        if len(ties) > wanted:
            ties = ties[np.argpartition(rank[ties], wanted - 1)[:wanted]]
        chosen = np.concatenate([above, ties])
    return chosen[np.lexsort((rank[chosen], -scores[chosen]))]


def _sides(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """For each dimension of the block: the anchors' row numbers and components, the candidates in order of label and id, their ids, nodes and ranks by id, their labels' ranges and components packed."""
    dims = [np.array(t.column("dim").to_pylist(), np.int64) for t in (anchors, rows)]
    for dim in np.intersect1d(*dims).tolist():
        a, c = (np.flatnonzero(d == dim) for d in dims)
        left, right = anchors.take(pa.array(a)), rows.take(pa.array(c))
        levels, ours = (np.array(t.column("levels").combine_chunks().flatten(), np.int64).reshape(len(t), dim) for t in (right, left))
        ids = right.column("vec_id").to_pylist()
        by_id = np.lexsort(([i or 0 for i in ids], [i is None for i in ids]))
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        names, label = np.unique(np.array(right.column("label").to_pylist(), object), return_inverse=True)
        order = np.lexsort((rank, label))
        ends = np.concatenate([[0], np.cumsum(np.bincount(label, minlength=len(names)))]).tolist()
        ranges = {name: (ends[k], ends[k + 1]) for k, name in enumerate(names)}
        packed = Packed(levels[order], int(np.abs(ours).max(initial=0)))
        node = right.column("node").to_numpy()[order]
        yield left, ours.tolist(), [ids[k] for k in order], node, rank[order], ranges, packed


FOUND = "anchor long, place int, score long, vec_id long"
_FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _table(found: list[tuple]) -> pa.Table:
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(_FOUND.types)], schema=_FOUND)


def _positives(count: int):
    """A block's best candidates of each anchor's label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        for left, levels, ids, nodes, rank, ranges, packed in _sides(anchors, rows):
            for node, label, own in zip(left.column("node").to_pylist(), left.column("label").to_pylist(), levels, strict=True):
                first, last = ranges.get(label, (0, 0))
                scores = packed.scores(own, first, last)
                others = np.flatnonzero(nodes[first:last] != node)
                for k in others[best(scores[others], rank[first:last][others], count)].tolist():
                    found.append((node, 0, int(scores[k]), ids[first + k]))
        return _table(found)

    return run


def _negatives(count: int, low: int, high: int):
    """A block's best candidates of other labels for each positive of each anchor."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        for left, levels, ids, _, rank, ranges, packed in _sides(anchors, rows):
            for node, label, positives, own in zip(left.column("node").to_pylist(), left.column("label").to_pylist(), left.column("positives").to_pylist(), levels, strict=True):
                first, last = ranges.get(label, (0, 0))
                scores = packed.scores(own, 0, packed.count)
                scores[first:last] = np.iinfo(np.int64).min
                for place, p in enumerate(positives):
                    least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                    open_to = np.flatnonzero((scores >= least) & (scores <= most))
                    for k in open_to[best(scores[open_to], rank[open_to], count)].tolist():
                        found.append((node, place, int(scores[k]), ids[k]))
        return _table(found)

    return run


def levels_of(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that take part: vec_id, label as text, dim, levels (whole numbers)."""
    v = F.col("v")
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    # of as many components, none larger than this: every sum stays within 8 bytes
    bound = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(v), F.lit(1))))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x) < bound))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    kept = rows.filter(F.col("label").isNotNull() & v.isNotNull() & F.coalesce(usable, F.lit(False)))
    return kept.select("vec_id", "label", F.size(v).alias("dim"), scaled.cast("array<int>").alias("levels"))


def hard_negatives(
    vectors: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels that score from low to high hundredths of the positive's score.

    A row's score is the inner product of its components and the anchor's, each times scale
    and rounded down. Anchors are the rows whose id every divides; an anchor's positives are
    the best other rows of its label. Returns per negative anchor_id, positive_id, rank,
    negative_id, positive_score and negative_score; ties go by the smaller id, null ids
    last. Rows with a null label or vector, or a null component or one that isn't finite,
    take no part; nor do rows whose scaled components reach the square root of 2 ** 61 over
    their number, whose products could leave a long. Vectors of different lengths don't
    meet. Rows that repeat an id are rows each: every one of them is an anchor, positive or
    negative of its own. Other columns are not read. Anchors without positives, and
    positives without negatives, give no rows, nor does an empty table.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    usable = levels_of(vectors, scale, id_col, vector_col, label_col)
    rows = stash(usable.withColumn("node", F.monotonically_increasing_id()), "levels")
    chosen = rows.filter(F.col("vec_id") % every == 0)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    cuts = max(1, -(-sizes["n"] // CUT), min(CUTS, math.ceil(sizes["n"] / FIELDS)))
    anchor_cuts = max(1, -(-sizes["anchors"] // CUT))
    cut, anchor_cut = (F.pmod(F.xxhash64("node"), F.lit(n)).cast("int") for n in (cuts, anchor_cuts))

    def met(anchors: DataFrame, work) -> DataFrame:
        """Every cut of anchors with every cut of candidates."""
        left = anchors.select(anchor_cut.alias("across"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("along"), *anchors.columns)
        right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(anchor_cuts - 1))).alias("across"), cut.alias("along"), *rows.columns)
        return left.groupBy("across", "along").cogroup(right.groupBy("across", "along")).applyInArrow(work, FOUND)

    def merged(found: DataFrame, count: int) -> DataFrame:
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)

    near = stash(merged(met(chosen, _positives(positives)), positives), "positives")
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("positives"))
    armed = stash(chosen.join(lists, chosen["node"] == lists["anchor"]).drop("anchor"), "armed-anchors")
    far = merged(met(armed, _negatives(negatives, low, high)), negatives)
    told = armed.select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    out = far.join(told, ["anchor", "place"])
    return out.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
