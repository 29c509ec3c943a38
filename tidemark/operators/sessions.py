"""Sessions in which paths are surfaced and files are opened: what was opened after it was surfaced, and how soon.

steps has a row for every open and for every surfaced path: sid, ord (the surfaced paths
of one injection share it), kind ('open' or 'inject'), slot (place in the injection), path, mode,
source and tool. An open meets a surfaced path if it ends with it at a folder's boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import wilson

#: Opens in which a first touch counts; bounds of a source's multiplier, and surfaced paths it needs.
FIRST_TOUCH, LOW, HIGH, LEAST = 8, 0.7, 1.3, 30
#: Opens and edits that a session needs, and the share of its edits that makes a folder its worksite.
OPENS, EDITS, WORKSITE = 3, 2, 0.5


def endings(path: Column) -> Column:
    """A path and all that follows one of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 1)


def matched(steps: DataFrame) -> DataFrame:
    """Surfaced paths with opens (of the session before), total (of the session), after, before and touch: the place among the next opens at which it was opened.

    Opens are numbered once; whether a path is opened before or after comes from the first
    and last number of its endings, and a touch from eight equi-joined numbers, so that no
    surfaced path meets all opens of its session.
    """
    is_open = F.col("kind") == "open"
    numbered = steps.withColumn("opens", F.count_if(is_open).over(Window.partitionBy("sid").orderBy("ord"))).withColumn("total", F.max("opens").over(Window.partitionBy("sid")))
    ends = numbered.filter(is_open).select("sid", F.col("opens").alias("at"), F.explode(endings(F.col("path"))).alias("path"))
    span = ends.groupBy("sid", "path").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    shown = numbered.filter(F.col("kind") == "inject")
    ahead = shown.select("sid", "ord", "slot", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(FIRST_TOUCH)), lambda k: F.col("opens") + k)).alias("k", "at"))
    touch = ahead.join(ends, ["sid", "path", "at"]).groupBy("sid", "ord", "slot").agg((F.min("k") + 1).alias("touch"))
    found = shown.join(span, ["sid", "path"], "left").join(touch, ["sid", "ord", "slot"], "left")
    return found.select(
        "sid", "ord", "slot", "path", "mode", "source", "opens", "total",
        F.coalesce(F.col("last") > F.col("opens"), F.lit(False)).alias("after"), F.coalesce(F.col("first") <= F.col("opens"), F.lit(False)).alias("before"), "touch",
    )


def injections(found: DataFrame) -> DataFrame:
    """Per injection its surfaced paths, how many were opened, and the first touch; missed if opens came and none of the first eight was surfaced."""
    one = found.groupBy("sid", "mode", "ord").agg(F.count("*").alias("surfaced"), F.count_if("after").alias("opened"), F.min("touch").alias("touch"), F.max(F.col("total") > F.col("opens")).alias("seen"))
    return one.withColumn("missed", F.col("touch").isNull() & F.col("seen"))


def session_scores(found: DataFrame) -> DataFrame:
    return injections(found).groupBy("sid", "mode").agg(
        F.count("*").alias("injections"), F.sum("surfaced").alias("surfaced"), F.sum("opened").alias("opened"), F.count("touch").alias("touched"), F.count_if("missed").alias("missed"),
    )


def corpus(found: DataFrame) -> DataFrame:
    """All sessions' injections by mode; the median of the first touches is the lower one."""
    tries = F.count("touch") + F.count_if("missed")
    return injections(found).groupBy("mode").agg(
        F.count("*").alias("injections"), F.sum("surfaced").alias("surfaced"), F.sum("opened").alias("opened"), percent(F.sum("opened"), F.sum("surfaced")).alias("coverage_pct"), tries.alias("tries"), F.count("touch").alias("touched"),
        percent(F.count("touch"), tries).alias("touched_pct"), percent(F.count_if(F.col("touch") == 1), tries).alias("first_pct"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY touch)").cast("long").alias("median_touch"),
    )


def by_source(found: DataFrame) -> DataFrame:
    """Coverage of each mode's sources with its score interval."""
    rates = found.groupBy("mode", "source").agg(F.count("*").alias("surfaced"), F.count_if("after").alias("opened"))
    low, high = wilson(F.col("opened"), F.col("surfaced"))
    return rates.select("*", percent(F.col("opened"), F.col("surfaced")).alias("coverage_pct"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def priors(found: DataFrame, least: int = LEAST) -> DataFrame:
    """A multiplier for each source: its rate against the mean of all that have enough surfaced paths, within bounds; 1 for the others."""
    rates = found.groupBy("source").agg(F.count("*").alias("surfaced"), F.count_if("after").alias("opened"))
    enough = rates.filter(F.col("surfaced") >= least).agg((F.sum("opened") / F.sum("surfaced")).alias("mean"))
    raw = F.col("opened") / F.col("surfaced") / F.col("mean")
    prior = F.when((F.col("surfaced") < least) | (F.coalesce("mean", F.lit(0)) == 0), 1.0).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), raw)))
    return rates.crossJoin(F.broadcast(enough)).select("source", "surfaced", "opened", F.round(prior, 6).alias("prior"))  # enough is one row


def surfacings(found: DataFrame, is_test: Column) -> DataFrame:
    """What became of each source's surfaced paths."""
    return found.groupBy("source").agg(
        F.count("*").alias("instances"), F.countDistinct("sid", "path").alias("files"), F.count_if("after").alias("after"), F.count_if(F.col("before") & ~F.col("after")).alias("before_only"), F.count("touch").alias("within"),
        percent(F.count_if("after"), F.count("*")).alias("after_pct"), percent(F.count_if(is_test), F.count("*")).alias("test_pct"),
    )


def most_surfaced(found: DataFrame, most: int = 8) -> DataFrame:
    """The paths that each source surfaces most often, and how often they were opened."""
    counted = found.groupBy("source", "path").agg(F.count("*").alias("n"), F.count_if("after").alias("opened"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "path"))).filter(F.col("place") <= most)


def wrong_starts(steps: DataFrame, folder: Column) -> DataFrame:
    """How often a session's first open lies outside its worksite, the folder of most edits (the first by name, if several), and how soon the worksite is opened.

    Sessions without enough opens or edits, or with edits all over, don't count. The median
    is the upper one, p90 the value at nine tenths; both come from counts by rank.
    """
    opens = steps.filter((F.col("kind") == "open") & ~F.col("path").startswith("/")).withColumn("folder", folder)
    edits = opens.filter("tool = 'Edit'").groupBy("sid", "folder").agg(F.count("*").alias("n"))
    named = edits.groupBy("sid").agg(F.min_by("folder", F.struct(-F.col("n"), "folder")).alias("site"), F.sum("n").alias("edits"), F.max("n").alias("most"))
    placed = opens.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("ord"))).join(named.filter((F.col("edits") >= EDITS) & (F.col("most") / F.col("edits") >= WORKSITE)), "sid")
    ranks = placed.groupBy("sid").agg(F.count("*").alias("opens"), F.min(F.when(F.col("folder") == F.col("site"), F.col("rank"))).alias("rank")).filter(F.col("opens") >= OPENS)
    counts = ranks.groupBy("rank").agg(F.count("*").alias("n"))
    upto = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("rank")), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))})  # a row for each rank
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("all") * share), F.col("rank")))
    sums = upto.agg(F.sum("n").alias("sessions"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("n"))), F.lit(0)).alias("wrong"), at(0.5).alias("median_rank"), at(0.9).alias("p90_rank"))
    return sums.select("*", percent(F.col("wrong"), F.col("sessions")).alias("wrong_pct"))
