"""How much more often surfaced files are opened than plausible ones: each injection's files against sets that other sessions of its repository were given.

injections: repo, sid, ord, files (array of paths, as surfaced). opens: sid, ord, path.
An open meets a surfaced path if it ends with it at a folder's boundary and comes later.

The null draws are numbers, no rejected tries: a repository's sets are cut into windows of
sets of like sizes, each window's sets are numbered by session, and a draw counts past the
session's own numbers. Draws come from a hash of the seed, the session, the place in it and
the round, so any partitioning gives the same ones. They are made where the sets are and
never shuffled: a cell is a block of a window's sets with a slice of its sessions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.operators.sessions import endings
from tidemark.sources.shared import written

#: Rounds and seed.
ROUNDS, SEED = 200, 12345
#: A multiplicative generator: modulus and the factors of its two steps.
MODULUS, FACTORS = 2_147_483_647, (48_271, 69_621)
#: Sets of a window.
WINDOW = 32


#: Sets of a block (or four times as many files), which a task holds at once; a window has one block for as many. Injections or sets of a row, slices of a window at most and sets for each.
BLOCK, SLAB, SLICES, SLICE = 2_000_000, 64, 16, 4096
#: Draws and files that one vectorised step works on, and places of its table of opened files.
STEP = 2_000_000
NEVER, ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SUMS = ["surfaced", "opened", "null_surfaced", "null_opened"]


def stirred(state, part):
    """Numbers from 0 to the modulus, stirred twice for a part."""
    for factor in FACTORS:
        state = (state + part) % MODULUS * factor % MODULUS
    return state


def last_opens(opens: DataFrame, surfaced: DataFrame) -> DataFrame:
    """(sid, path, last): every ending of an opened path that is surfaced (path) anywhere, and when it was last opened."""
    named = opens.filter((F.coalesce(F.col("path"), F.lit("")) != "") & F.col("ord").isNotNull())
    ends = named.select("sid", "ord", F.explode(endings(F.col("path"))).alias("path")).join(surfaced, "path", "left_semi")
    return ends.groupBy("sid", "path").agg(F.max("ord").cast("long").alias("last"))


def numbered(injections: DataFrame, window: int | None) -> DataFrame:
    """Adds place and own: a window's sets are numbered by session, own is the first number of the session's and mine how many; pool is the window's size, held its files.

    A repository's sets stand in order of size; a window is as many of them that follow each
    other. Sets of a window are at most that many, so what numbers it is small; without a
    window all sets of a repository are one, and numbers come from counts by session.
    """
    sized = injections.withColumn("size", F.size("files"))
    if window:
        # the rank by size: counts of smaller sizes, then the place among equals by session
        counts = sized.groupBy("repo", "size").agg(F.count("*").alias("n"))
        before = counts.withColumn("smaller", F.sum("n").over(Window.partitionBy("repo").orderBy("size")) - F.col("n")).drop("n")
        among = sized.groupBy("repo", "size", "sid").agg(F.count("*").alias("n"))
        ahead = among.withColumn("earlier", F.sum("n").over(Window.partitionBy("repo", "size").orderBy("sid")) - F.col("n")).drop("n")
        inside = F.row_number().over(Window.partitionBy("repo", "size", "sid").orderBy("ord")) - 1
        ranked = sized.withColumn("inside", inside).join(before, ["repo", "size"]).join(ahead.hint("merge"), ["repo", "size", "sid"])
        ranked = ranked.withColumn("stratum", F.floor((F.col("smaller") + F.col("earlier") + F.col("inside")) / window)).drop("inside", "smaller", "earlier")
    else:
        ranked = sized.withColumn("stratum", F.lit(0).cast("long"))
    by_session = ranked.groupBy("repo", "stratum", "sid").agg(F.count("*").alias("mine"), F.sum("size").alias("held"))
    spread = Window.partitionBy("repo", "stratum")
    by_session = by_session.withColumns({"own": F.sum("mine").over(spread.orderBy("sid")) - F.col("mine"), "pool": F.sum("mine").over(spread), "held": F.coalesce(F.sum("held").over(spread), F.lit(0))})
    here = F.row_number().over(Window.partitionBy("repo", "stratum", "sid").orderBy("ord")) - 1
    return ranked.withColumn("here", here).join(by_session.hint("merge"), ["repo", "stratum", "sid"]).withColumn("place", F.col("own") + F.col("here")).drop("here")


def cells(placed: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of cells: first a block's sets by place, up to SLAB in a row (files), then the asking injections, up to SLAB of one session in a row (names are its opened files).

    Every set goes to each slice of its window, every injection to each block. Slices are 16
    at most however large the window, and blocks one up to two million sets.
    """
    over = lambda x, n: F.floor((x + n - 1) / n).cast("long")
    slices = F.least(F.lit(SLICES).cast("long"), over(F.col("pool"), SLICE))
    blocks = F.greatest(over(F.col("pool"), BLOCK), over(F.col("held"), 4 * BLOCK))
    cut = placed.withColumns({"slices": slices, "width": F.greatest(over(F.col("pool"), blocks), F.lit(1).cast("long"))})
    none = lambda kind: F.lit(None).cast(kind)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    of_sets = [F.lit(0).alias("kind"), F.col("held")[0]["place"].alias("place"), F.col("held.files").alias("files"), none("array<string>").alias("names"), *(none("array<long>").alias(c) for c in ("lasts", "places", "ords", "sizes")), *(none("long").alias(c) for c in ("sid", "own", "mine", "pool"))]
    slabs = cut.groupBy("repo", "stratum", "slices", F.floor(F.col("place") / F.col("width")).alias("block"), F.floor(F.col("place") % F.col("width") / SLAB).alias("slab")).agg(F.array_sort(F.collect_list(F.struct("place", "files"))).alias("held"))
    sets = slabs.select("repo", "stratum", upto(F.col("slices")).alias("slice"), "block", *of_sets)
    mine = F.array_sort(F.collect_list(F.struct("place", F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))))
    rows = cut.groupBy("repo", "stratum", "sid", "own", "mine", "pool", "slices", "width", F.floor((F.col("place") - F.col("own")) / SLAB).alias("slab")).agg(mine.alias("asked"))
    opened = last.groupBy("sid").agg(F.collect_list(F.struct("path", "last")).alias("opened"))
    asks = rows.join(opened.hint("merge"), "sid", "left").withColumn("slice", F.pmod(F.xxhash64("sid", "slab"), F.col("slices")))
    of_asks = [F.lit(1).alias("kind"), F.col("asked")[0]["place"].alias("place"), none("array<array<string>>").alias("files"), F.col("opened.path").alias("names"), F.col("opened.last").alias("lasts"), *(F.col(f"asked.{c}").alias(f"{c}s") for c in ("place", "ord", "size")), F.col("sid").cast("long").alias("sid"), "own", "mine", "pool"]
    asks = asks.select("repo", "stratum", "slice", upto(over(F.col("pool"), F.col("width"))).alias("block"), *of_asks)
    where = ["repo", "stratum", "slice", "block"]
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.unionByName(asks).repartition(tasks, *where).sortWithinPartitions(*where, "kind", "place")


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of lists, and where each list begins."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _spans(sizes: np.ndarray) -> Iterator[slice]:
    """Stretches whose sizes sum up to a step, one item at least."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        yield slice(at, end)
        at = end


class Block:
    """Sets of a window whose places follow each other, and what they come to for sessions that are given them."""

    def __init__(self, rows: list[pa.RecordBatch], rounds: int, seed: int, resize: bool):
        self.rounds, self.seed, self.resize = np.arange(1, rounds + 1), seed, resize
        names, self.at = _flat(pa.concat_arrays([r.column("files").flatten() for r in rows]))
        coded = names.dictionary_encode()
        self.names = coded.dictionary
        self.files = coded.indices.fill_null(len(self.names)).to_numpy(zero_copy_only=False)  # one more for files without a name
        self.low = rows[0].column("place")[0].as_py()
        self.high = self.low + len(self.at) - 1
        self.opened = np.full((max(1, min(256, STEP // (len(self.names) + 1))), len(self.names) + 1), NEVER)

    def counted(self, row: np.ndarray, order: np.ndarray, sets: np.ndarray) -> tuple[int, int]:
        """Files of sets (numbers in the block), and those opened later than order by the session of row."""
        sizes, hits = self.at[sets + 1] - self.at[sets], 0
        for s in _spans(sizes):
            n = sizes[s]
            at = np.repeat(self.at[sets[s]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hits += int((self.opened[np.repeat(row[s], n), self.files[at]] > np.repeat(order[s], n)).sum())
        return int(sizes.sum()), hits

    def redrawn(self, row: np.ndarray, order: np.ndarray, sets: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[int, int]:
        """The same for so many files of each set, drawn with replacement."""
        held, hits = self.at[sets + 1] - self.at[sets], 0
        for s in _spans(size):
            n = size[s]
            slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            at = np.repeat(self.at[sets[s]], n) + stirred(np.repeat(state[s], n), slot) % np.repeat(held[s], n)
            hits += int((self.opened[np.repeat(row[s], n), self.files[at]] > np.repeat(order[s], n)).sum())
        return int(size.sum()), hits

    def ask(self, rows: pa.RecordBatch) -> np.ndarray:
        """Sums over rows of asking injections."""
        names, ends = _flat(rows.column("names"))
        file = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        last = _flat(rows.column("lasts"))[0].to_numpy(zero_copy_only=False)
        place, starts = _flat(rows.column("places"))
        order = _flat(rows.column("ords"))[0]
        known = order.is_valid().to_numpy(zero_copy_only=False)
        order = order.fill_null(ALWAYS).to_numpy(zero_copy_only=False)
        place, size = place.to_numpy(zero_copy_only=False), _flat(rows.column("sizes"))[0].to_numpy(zero_copy_only=False)
        sid, own, mine, pool = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "own", "mine", "pool"))
        sums, at = np.zeros(4, np.int64), 0
        while at < rows.num_rows:
            # as many rows as the table has, or as a step's draws come from
            end = min(at + len(self.opened), max(at + 1, int(np.searchsorted(starts, starts[at] + STEP // len(self.rounds), "right")) - 1), rows.num_rows)
            met = slice(ends[at], ends[end])
            row = np.repeat(np.arange(end - at), np.diff(ends[at : end + 1]))[file[met] >= 0]
            column = file[met][file[met] >= 0]
            self.opened[row, column] = last[met][file[met] >= 0]
            asked = slice(starts[at], starts[end])
            sums += self._step(np.repeat(np.arange(at, end), np.diff(starts[at : end + 1])), at, place[asked], order[asked], size[asked], known[asked], sid, own, mine, pool)
            self.opened[row, column] = NEVER
            at = end
        return sums

    def _step(self, who, first, place, order, size, known, sid, own, mine, pool) -> np.ndarray:
        inside = (place >= self.low) & (place < self.high)
        real = self.counted(who[inside] - first, order[inside], place[inside] - self.low)
        who, order, size = who[known], order[known], size[known]
        own, mine, pool = own[who][:, None], mine[who][:, None], pool[who][:, None]
        others = pool - mine
        state = stirred(stirred(stirred(self.seed, sid[who]), order)[:, None], self.rounds)
        number = state % np.where(others > 0, others, pool)
        number += np.where((others > 0) & (number >= own), mine, 0)
        given = (number >= self.low) & (number < self.high)
        k, sets, state = np.nonzero(given)[0], number[given] - self.low, state[given]
        row, order, size, held = who[k] - first, order[k], size[k], self.at[sets + 1] - self.at[sets]
        if not self.resize:
            return np.array([*real, *self.counted(row, order, sets)])
        same, other = held == size, (held != size) & (size > 0) & (held > 0)
        whole = self.counted(row[same], order[same], sets[same])
        part = self.redrawn(row[other], order[other], sets[other], size[other], state[other])
        return np.array([*real, whole[0] + part[0], whole[1] + part[1]])


def _sums(rounds: int, seed: int, resize: bool):
    def of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block, sums = None, [], None, np.zeros(4, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("repo", "stratum", "slice", "block", "kind")]
            new = np.zeros(batch.num_rows - 1, bool)
            for key in keys:
                new |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            for a, b in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]):
                *here, kind = (key[a].as_py() for key in keys)
                if here != cell:
                    cell, held, block = here, [], None
                rows = batch.slice(a, b - a)
                if kind == 0:
                    held.append(rows)
                    continue
                if block is None:
                    block, held = Block(held, rounds, seed, resize), []
                sums += block.ask(rows)
        yield pa.RecordBatch.from_arrays([pa.array([int(n)]) for n in sums], SUMS)

    return of_cells


def lift(injections: DataFrame, opens: DataFrame, *, rounds: int = ROUNDS, seed: int = SEED, window: int | None = WINDOW, resize: bool = True) -> DataFrame:
    """One row: surfaced and opened files, their share, the null's share and the lift between them.

    Repositories with fewer than two sets don't count. With resize, a drawn set of another
    size gives as many files as the real one has, each drawn with replacement. Shares are
    null without files, the lift where a share is null or 0.
    """
    ship_package(injections.sparkSession)
    enough = injections.groupBy("repo").agg(F.count("*").alias("sets")).filter("sets >= 2").select("repo")
    placed = written(numbered(injections.join(enough, "repo", "left_semi"), window), "placed-sets")
    surfaced = written(placed.select(F.explode("files").alias("path")).distinct(), "surfaced")
    found = cells(placed, last_opens(opens, surfaced)).mapInArrow(_sums(rounds, seed, resize), ", ".join(f"{c} long" for c in SUMS))
    both = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS))
    share = lambda a, b: F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b))
    both = both.withColumns({"a": share("opened", "surfaced"), "b": share("null_opened", "null_surfaced")})
    ratio = F.when((F.col("a") > 0) & (F.col("b") > 0), F.round(F.col("a") / F.col("b"), 2))
    return both.select("surfaced", "opened", "null_surfaced", "null_opened", F.round("a", 2).alias("actual_pct"), F.round("b", 2).alias("null_pct"), ratio.alias("lift"))
