"""Range, as-of and suffix joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest_enclosing(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """For each point (key, id, at) the shortest span (key, first, last) that holds it, by equal cells of `width` so that the join has an equality."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    met = points.withColumn("cell", F.floor(F.col("at") / width)).join(cells, ["key", "cell"]).filter("first <= at and at <= last")
    best = Window.partitionBy("key", "id").orderBy(F.col("last") - F.col("first"), "first")
    return met.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("key", "id", "at", "first", "last")


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before it: a union and a running last value, with one shuffle."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).select("*").unionByName(
        right.select(key, order, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    before = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(before)).filter("_side = 1").drop("_v", "_side")


def suffix_semi_join(surfaced: DataFrame, opened: DataFrame) -> DataFrame:
    """Surfaced paths that an opened path ends with, at a directory boundary."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))
    return surfaced.join(opened.select(F.explode(ends).alias("path")).distinct(), "path", "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """How each key changed between two snapshots."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
