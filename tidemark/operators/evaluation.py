"""Usefulness of evaluated cases, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lift beyond this is positive or negative; one below the floor is told.
LIFT, FLOOR = 0.01, -0.05


def usefulness() -> Column:
    """0.3 of the primary file's place, 0.3 of the hits, 0.2 of the precision, 0.2 of related files; a negative case wants no files at all.

    Columns: negative, ranked (files given), primary_rank (from 0; null if absent), good_hits, warnings, exact, graph, related and
    lib_related (related files, and those that are neither tests nor vendored), p_on.
    """
    rank = F.col("primary_rank")
    place = F.when(rank == 0, 1.0).when(rank <= 2, 0.7).when(rank <= 9, 0.4).otherwise(0.0)
    hits = F.when(F.col("good_hits"), 1.0).otherwise(0.2) - F.coalesce("warnings", F.lit(0)) * 0.1 + F.when(F.col("exact"), 0.1).otherwise(0.0)
    hits = F.greatest(F.lit(0.0), F.least(F.lit(1.0), hits))
    related = F.when(~F.col("graph"), 0.5).when(F.coalesce("related", F.lit(0)) == 0, 0.0).when(F.col("lib_related") > 0, 1.0).otherwise(0.5)
    whole = 0.3 * place + 0.3 * hits + 0.2 * F.coalesce("p_on", F.lit(0.0)) + 0.2 * related
    return F.when(F.col("negative"), F.when(F.col("ranked") == 0, 1.0).otherwise(0.0)).otherwise(whole)


def aggregates(cases: DataFrame) -> DataFrame:
    """Means over cases that aren't negative, nulls left out and 0 without any; lift is with the graph less without."""
    own = ~F.col("negative")
    mean = lambda c: F.coalesce(F.avg(F.when(own, c)), F.lit(0.0))
    lift = mean(F.col("n_on")) - mean(F.col("n_off"))
    return cases.agg(
        F.count("*").alias("cases"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"), F.round(mean(F.col("p_on")), 6).alias("mean_precision"), F.round(mean(F.col("mrr")), 6).alias("mean_mrr"), F.round(mean(F.col("n_on")), 6).alias("mean_ndcg"),
        F.round(mean(usefulness()), 6).alias("mean_usefulness"), F.round(mean(F.col("p_on")) - mean(F.col("p_off")), 6).alias("lift_precision"), F.round(lift, 6).alias("lift_ndcg"),
        F.when(lift > LIFT, "positive").when(lift < -LIFT, "negative").otherwise("neutral").alias("direction"), F.count_if(own & (F.col("n_on") - F.col("n_off") < FLOOR)).alias("breaches"),
    )
