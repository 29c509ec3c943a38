"""Statistics as column expressions, and retrieval metrics over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, attempts: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a rate, within 0 and 1; null without attempts."""
    p, n = successes / attempts, attempts
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = ((centre + s * spread) / (1 + z * z / n) for s in (-1, 1))
    some = F.when(n > 0, F.lit(True))
    return F.when(some, F.greatest(low, F.lit(0.0))), F.when(some, F.least(high, F.lit(1.0)))


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Hybrid score interval of the difference of two rates, first less second."""
    (l1, u1), (l2, u2), p1, p2 = wilson(k1, n1), wilson(k2, n2), k1 / n1, k2 / n2
    below = F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    above = F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return p1 - p2 - below, p1 - p2 + above


def percentiles(value: str, points: list[float]) -> Column:
    """Linear interpolation, exact."""
    return F.percentile(value, F.array(*map(F.lit, points)))


def trimmed_recent_p95(rows: DataFrame, key: str, value: str, order: str, *, recent: int, trim: float) -> DataFrame:
    """Nearest-rank 95th percentile of each key's most recent values, its slowest share left out."""
    last = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("rn") <= recent)
    ranked = last.withColumns({"slow": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), F.desc(order))), "n": F.count("*").over(Window.partitionBy(key))})
    kept = ranked.filter(F.col("slow") > F.floor(F.col("n") * trim))
    return kept.groupBy(key).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.count("*").alias("samples"))


def precision_at(ranked: DataFrame, k: int) -> DataFrame:
    """Rows of (query, rank, gain): share of the first k that is relevant, half for a gain under 1."""
    hits = F.sum(F.when(F.col("gain") >= 1, 1.0).when(F.col("gain") > 0, 0.5).otherwise(0.0))
    return ranked.filter(F.col("rank") <= k).groupBy("query").agg(F.round(hits / F.greatest(F.count("*"), F.lit(1)), 6).alias("precision"))


def reciprocal_rank(ranked: DataFrame, k: int) -> DataFrame:
    first = F.min(F.when((F.col("gain") >= 1) & (F.col("rank") <= k), F.col("rank")))
    return ranked.groupBy("query").agg(F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("mrr"))


def ndcg_at(ranked: DataFrame, k: int) -> DataFrame:
    """Rows of (query, rank, gain); a relevant row that wasn't ranked has no rank and counts for the ideal alone."""
    discounted = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col("gain") / F.log2(F.col(rank) + 1)).otherwise(0.0))
    ideal = ranked.withColumn("best", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), F.asc_nulls_last("rank"))))
    return ideal.groupBy("query").agg(F.round(F.when(discounted("best") > 0, discounted("rank") / discounted("best")).otherwise(0.0), 6).alias("ndcg"))


def recall(relevant: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """Per case the share of its relevant items that were found."""
    seen = found.select(key, item).distinct().withColumn("seen", F.lit(1))
    return relevant.select(key, item).distinct().join(seen, [key, item], "left").groupBy(key).agg(F.round(F.count("seen") / F.count("*"), 6).alias("recall"))


#: Numbers of a session's opened files that one row holds.
OPENED = 1000


def numbers_below(spark, size: DataFrame) -> DataFrame:
    """number: from 0 up to a size (one row) that only Spark knows, by way of blocks."""
    block = 1 << 16
    blocks = size.filter("size > 0").select("size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block))).alias("block")).repartition("block")
    inside = blocks.select("size", "block", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("at"))
    return inside.select("size", (F.col("block") * block + F.col("at")).alias("number")).filter("number < size")


def permutation_lift(injected: DataFrame, opened: DataFrame, pool: DataFrame, *, rounds: int, seed: int) -> DataFrame:
    """Hit rate of injected files (session, slot, path) against opened ones, and of random files of the pool (path, number from 0) in their place.

    A draw's number comes from a hash of seed, session, slot and round, so any partitioning
    gives the same draws. They are made beside the numbers of the session's opened files, in
    lists of at most OPENED, and counted there: no draw is shuffled. Numbers that the pool
    lacks or has several times are few, as it counts from 0; draws of the former don't count.
    """
    hits = opened.select("session", "path").distinct().withColumn("hit", F.lit(1))
    actual = injected.join(hits, ["session", "path"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("rate"))
    size = pool.agg(F.count("*").alias("size"))
    wanted = pool.select("number").unionByName(numbers_below(pool.sparkSession, size).select("number"))
    strays = wanted.groupBy("number").agg((F.count("*") - 1).alias("files")).filter("files != 1")
    place = F.floor((F.row_number().over(Window.partitionBy("session").orderBy("number")) - 1) / OPENED).alias("list")
    lists = hits.join(pool, "path").select("session", "number").select("session", "number", place).groupBy("session", "list").agg(F.collect_list("number").alias("numbers"))
    beside = injected.select("session", "slot").join(lists, "session", "left").join(F.broadcast(size))  # one row
    draws = beside.select("session", "slot", "size", "list", "numbers", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    number = F.pmod(F.xxhash64(F.lit(seed), "session", "slot", "round"), F.col("size")).alias("number")
    drawn = draws.select("list", "numbers", number).join(F.broadcast(strays), "number", "left")
    met = F.when(F.array_contains("numbers", F.col("number")), F.size(F.filter("numbers", lambda x: x == F.col("number")))).otherwise(0)
    once = F.when(F.coalesce("list", F.lit(0)) == 0, F.coalesce("files", F.lit(1))).otherwise(0)
    null = drawn.agg((F.sum(met) / F.sum(once)).alias("null_rate"))
    return actual.join(F.broadcast(null)).withColumn("lift", F.when(F.col("null_rate") > 0, F.col("rate") / F.col("null_rate")))  # one row each
