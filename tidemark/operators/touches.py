"""What touches of files call for: dependents not seen yet, importers to resolve anew, edits of surfaced lines."""

from __future__ import annotations

from functools import reduce
from operator import or_
from posixpath import basename, dirname, splitext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tools whose calls edit a place in a file, and stems that stand for their folder.
EDIT_TOOLS, FOLDER_STEMS = ["Edit", "Write", "MultiEdit", "NotebookEdit"], ["index", "__init__"]
#: Fixed value: more importers than this are left to a whole scan.
MOST_IMPORTERS = 200


def untouched_dependents(touches: DataFrame, dependents: DataFrame) -> DataFrame:
    """For each session's touches (sid, ord, path) the dependents (path, dependent) it hasn't touched by then, each told once.

    A dependent's first touch is compared with the touch that tells of it, so no session's
    set of touched files is ever gathered.
    """
    first = touches.groupBy("sid", F.col("path").alias("dependent")).agg(F.min("ord").alias("touched"))
    told = touches.join(dependents, "path").join(first, ["sid", "dependent"], "left").filter("touched is null or touched > ord")
    return told.groupBy("sid", "dependent").agg(F.min("ord").alias("ord"), F.min_by("path", F.struct("ord", "path")).alias("path"))


def repair_set(edges: DataFrame, changed: list[str], most: int = MOST_IMPORTERS) -> DataFrame:
    """Importers of edges (importer, specifier, to_path, kind) to resolve anew after some files came or went; none if there are more than most.

    They are those with unresolved imports, those that import a changed file, and those
    whose specifiers hold a changed file's stem, or its folder's name where the stem stands for that.
    """
    stems = [(splitext(basename(c))[0], basename(dirname(c))) for c in changed]
    tokens = sorted({s for s, _ in stems} | {d for s, d in stems if s in FOLDER_STEMS and d})
    named = reduce(or_, (F.lower("specifier").contains(t.lower()) for t in tokens), F.lit(False))
    found = edges.filter((F.col("kind") == "unresolved") | F.col("to_path").isin(changed) | named).filter(~F.col("importer").isin(changed)).select("importer").distinct()
    few = found.limit(most + 1).agg((F.count("*") <= most).alias("few"))
    return found.join(F.broadcast(few), F.col("few"), "left_semi")  # few is one row


def edits_of_surfaced(surfaced: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """Edits (calls by id, their results by the same id) of files that were surfaced with a line before: whether they meet it, and the opens in between.

    surfaced has sid, ord, path, line and source; calls sid, ord, id, tool; results id, path, first and
    last line. The first edit after a row was surfaced whose lines are known uses it up, the
    others pass it over; the last result of an id counts.
    """
    done = results.groupBy("id").agg(F.max_by(F.struct("path", "first", "last"), F.struct("at", "path")).alias("edit"))
    rows = surfaced.groupBy("sid", "path", "ord").agg(F.min(F.struct("line", "source")).alias("row")).withColumn("side", F.lit(0))
    both = rows.unionByName(calls.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("opens", F.sum("side").over(Window.partitionBy("sid").orderBy("ord", "side", "id", "path").rowsBetween(Window.unboundedPreceding, 0)))
    edits = both.filter((F.col("side") == 1) & F.col("tool").isin(EDIT_TOOLS)).drop("path").join(done.filter("edit.first is not null and edit.last is not null"), "id").withColumn("path", F.col("edit.path"))
    shown = F.when(F.col("side") == 0, F.struct("ord", "row", "opens"))
    both = both.filter("side = 0").unionByName(edits, allowMissingColumns=True)
    latest = both.withColumn("shown", F.last(shown, ignorenulls=True).over(Window.partitionBy("sid", "path").orderBy("ord", "side", "id"))).filter("side = 1 and shown is not null")
    first = latest.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "path", "shown.ord").orderBy("ord", "id"))).filter("nth = 1")
    hit = F.col("shown.row.line").between(F.col("edit.first"), F.col("edit.last"))
    return first.select("sid", "path", "id", F.col("shown.row.source").alias("source"), hit.alias("hit"), (F.col("opens") - F.col("shown.opens")).alias("opens"))
