"""What agents of a task have in common, and what has become of the claims they were served.

Only listed agents take part, at most 64 of a task, so a path that all of them hold gives a
bounded number of pairs, however many agents there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that are told of a task, and shared items of a pair.
MOST_PAIRS, MOST_ITEMS = 64, 50
STATES = ["unchanged", "changed", "invalidated", "unknown"]


def overlaps(listed: DataFrame, worksets: DataFrame, *, current: DataFrame | None = None) -> DataFrame:
    """Pairs of listed agents (task, agent) whose worksets (task, agent, kind path or region, item) share something.

    Returns task, a, b, shared_paths and shared_regions (the first fifty by name), their
    totals, involves_current (an agent of current: task, agent), place (by names, up to 64)
    and pairs, how many the task has.
    """
    own = worksets.join(listed.select("task", "agent").distinct(), ["task", "agent"], "left_semi").select("task", "agent", "kind", "item").distinct()
    met = own.withColumnRenamed("agent", "a").join(own.withColumnRenamed("agent", "b"), ["task", "kind", "item"]).filter("a < b")
    totals = met.groupBy("task", "a", "b").agg(F.count_if(F.col("kind") == "path").alias("path_total"), F.count_if(F.col("kind") == "region").alias("region_total"))
    placed = totals.withColumns({"place": F.row_number().over(Window.partitionBy("task").orderBy("a", "b")), "pairs": F.count("*").over(Window.partitionBy("task"))}).filter(F.col("place") <= MOST_PAIRS)
    nth = F.row_number().over(Window.partitionBy("task", "a", "b", "kind").orderBy("item"))
    first = met.join(placed.select("task", "a", "b"), ["task", "a", "b"], "left_semi").withColumn("nth", nth).filter(F.col("nth") <= MOST_ITEMS)
    items = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("item"))))
    shared = first.groupBy("task", "a", "b").agg(items("path").alias("shared_paths"), items("region").alias("shared_regions"))
    out = placed.join(shared, ["task", "a", "b"])
    if current is None:
        return out.withColumn("involves_current", F.lit(False))
    now = current.select("task", F.col("agent").alias("now")).distinct()
    return out.join(now, "task", "left").withColumn("involves_current", F.coalesce(F.col("now").isin(F.col("a"), F.col("b")), F.lit(False))).drop("now")


def totals(listed: DataFrame, claims: DataFrame) -> DataFrame:
    """Per task its listed agents and how many of their claims (task, agent, status) are in each state; agents without claims count."""
    own = listed.select("task", "agent").distinct()
    counted = claims.join(own, ["task", "agent"], "left_semi").groupBy("task").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES))
    return own.groupBy("task").agg(F.count("*").alias("agents")).join(counted, "task", "left").na.fill(0)
