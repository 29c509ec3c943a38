"""Analytics over the append-only event log: rows of ord (append order), ts, sid, turn, name, arm, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import newcombe, percentiles


def in_window(events: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Half-open: since is in, until is out; rows without a time go."""
    out = events.filter("ts is not null")
    out = out if since is None else out.filter(F.col("ts") >= since)
    return out if until is None else out.filter(F.col("ts") < until)


def counts_and_span(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def duration_stats(events: DataFrame, by: list[str]) -> DataFrame:
    p = percentiles("value", [0.5, 0.95, 0.99])
    return events.groupBy(*by).agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(p[0], 4).alias("p50"), F.round(p[1], 4).alias("p95"), F.round(p[2], 4).alias("p99"), F.max("value").alias("most")
    )


def turn_rollup(events: DataFrame, is_open: Column, is_hit: Column) -> DataFrame:
    """Per turn its arm (that of the first row), opens, hits and the rank of the first hit among opens."""
    opens = events.filter(is_open).withColumn("rank", F.row_number().over(Window.partitionBy("sid", "turn").orderBy("ord")))
    return opens.groupBy("sid", "turn").agg(
        F.min_by("arm", "ord").alias("arm"), F.count("*").alias("opens"), F.count_if(is_hit).alias("hits"), F.min(F.when(is_hit, F.col("rank"))).alias("first_hit_rank")
    )


def arm_hit_rates(turns: DataFrame) -> DataFrame:
    return turns.groupBy("arm").agg(F.count("*").alias("turns"), F.count_if(F.col("hits") > 0).alias("hit_turns"), F.round(F.count_if(F.col("hits") > 0) / F.count("*"), 6).alias("rate"))


def arm_delta(turns: DataFrame) -> DataFrame:
    """Difference of the arms' turn hit rates with its interval, and whether that spans zero."""
    count = lambda arm, more=F.lit(True): F.count_if((F.col("arm") == arm) & more)
    hit = F.col("hits") > 0
    both = turns.agg(count("armed", hit).alias("k1"), count("armed").alias("n1"), count("holdback", hit).alias("k2"), count("holdback").alias("n2"))
    low, high = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    delta = F.col("k1") / F.col("n1") - F.col("k2") / F.col("n2")
    return both.select("k1", "n1", "k2", "n2", F.round(delta, 4).alias("delta"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), ((low <= 0) & (high >= 0)).alias("spans_zero"))


def gate(turns: Column, opens: Column, confounded: Column, floor: int) -> Column:
    return F.when(turns.isNull() | (turns == 0), "NO_ARM").when(confounded, "CONFOUNDED").when((turns >= floor) & (opens >= floor), "AT_VOLUME").otherwise("DORMANT")


def arm_precision(events: DataFrame, is_hit: Column, is_miss: Column) -> DataFrame:
    hits, all_ = F.count_if(is_hit), F.count_if(is_hit | is_miss)
    return events.groupBy("arm").agg(hits.alias("hits"), F.count_if(is_miss).alias("misses"), F.round(hits / F.nullif(all_, F.lit(0)), 4).alias("precision"))


def arm_distance(events: DataFrame, by: str) -> DataFrame:
    """Total variation between the arms' shares by a column; null if an arm has no rows."""
    counted = events.groupBy(by).pivot("arm", ["armed", "holdback"]).agg(F.count(F.lit(1))).na.fill(0)
    whole = Window.partitionBy(F.lit(1))
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return counted.withColumn("gap", F.abs(share("armed") - share("holdback"))).agg(F.round(0.5 * F.sum("gap"), 6).alias("distance"))


def hits_in_scope(events: DataFrame, opens_scope: Column, is_hit: Column) -> DataFrame:
    """Hits of a turn that come after a row which opened its scope, by append order."""
    so_far = Window.partitionBy("sid", "turn").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    scoped = events.withColumn("open", F.coalesce(F.max(opens_scope.cast("int")).over(so_far), F.lit(0)))
    return scoped.groupBy("arm").agg(F.count_if(is_hit).alias("hits"), F.count_if(is_hit & (F.col("open") == 1)).alias("scoped_hits"))


def mixed_sessions(events: DataFrame) -> DataFrame:
    """Sessions with more than one value of arm_by_turn."""
    return events.groupBy("sid").agg(F.countDistinct("arm_by_turn").alias("arms")).filter("arms > 1")


def collapse_attempts(events: DataFrame, terminal: str, success: str) -> DataFrame:
    """One row for each (sid, turn): the last terminal row, else the last success, else the last."""
    rank = F.when(F.col("name") == terminal, 2).when(F.col("name") == success, 1).otherwise(0)
    return events.groupBy("sid", "turn").agg(F.max_by(F.struct("name", "ord"), F.struct(rank, "ord")).alias("kept"), F.count("*").alias("rows")).select("sid", "turn", F.col("kept.name").alias("name"), F.col("kept.ord").alias("ord"), "rows")


def latest_by(events: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key by time, append order among equals."""
    last = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("ord"))
    return events.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")


def retention(events: DataFrame, key: str, cap: int) -> DataFrame:
    """At most cap rows: the newest of every key first, newest keys before others, then the newest of the rest."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("ord")))
    ranked = events.withColumn("history", (newest > 1).cast("int"))
    return ranked.orderBy("history", F.desc("ts"), F.desc("ord")).limit(cap).drop("history")


def rolling_count(events: DataFrame, key: str, span_ms: int) -> DataFrame:
    """Rows of a key in the span up to and with each row."""
    w = Window.partitionBy(key).orderBy("ts").rangeBetween(-span_ms, 0)
    return events.select("ord", key, F.count("*").over(w).alias("recent"))


def run_starts(events: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows whose value differs from the row before, by key in append order."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("ord"))
    return events.withColumn("before", before).filter(~F.col("before").eqNullSafe(value)).drop("before")
