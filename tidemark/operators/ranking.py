"""Ranked retrieval: fusing structural and textual evidence, reranking, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the scoring model.
FAN_IN_STEP, FAN_IN_CAP = 0.02, 0.15
COUNT_WEIGHT = 0.075


def fan_in_fraction(fan_in: Column) -> Column:
    """A saturating bonus for files that many import."""
    return F.least(F.lit(FAN_IN_CAP), F.log1p(fan_in.cast("double")) * FAN_IN_STEP)


def cap_per_file(hits: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("score"), "ord")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def rerank_files(hits: DataFrame, limit: int) -> DataFrame:
    """Files by their best hit plus a bonus that grows slowly with the number of hits."""
    files = hits.groupBy("path").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.max("fan_in").alias("fan_in"))
    scored = files.withColumn("total", F.round(F.col("best") * (1 + F.log1p(F.col("n").cast("double")) * COUNT_WEIGHT), 6))
    return scored.orderBy(F.desc("total"), F.desc("fan_in"), F.desc("n"), "path").limit(limit)


def within_budget(rows: DataFrame, key: str, order: list, size: Column, budget: int) -> DataFrame:
    """The first rows of each key whose sizes together fit; the first row always stays."""
    w = Window.partitionBy(key).orderBy(*order)
    summed = rows.withColumns({"used": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    return summed.filter((F.col("used") <= budget) | (F.col("place") == 1))


def first_tier(hits: DataFrame) -> DataFrame:
    """Of each query's hits only those of the strictest tier that has any."""
    return hits.withColumn("least", F.min("tier").over(Window.partitionBy("query"))).filter("tier = least").drop("least")
