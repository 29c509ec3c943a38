"""Claims that were served about files and symbols, and what has become of them; a task's closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.details import span_text


def minted(served: DataFrame, files: DataFrame) -> DataFrame:
    """A claim for each served row (task, path, symbol, first, last, line) whose file (path, hash) is there: id, predicate and the hash it is anchored to."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.concat(F.lit("c_"), F.substring(F.sha1(F.concat_ws("|", text("path"), text("symbol"), text("line"))), 1, 10))
    predicate = F.when(F.col("symbol").isNotNull(), "defines").when(F.col("first").isNotNull(), "region_at").otherwise("relevant")
    return served.join(files.select("path", F.col("hash").alias("anchor")), "path").select(name.alias("id"), "task", "path", "symbol", "first", "last", "line", predicate.alias("predicate"), "anchor")


def drift(claims: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each claim against the present files (path, hash, stable) and symbols (path, symbol, now_first, now_last; one row each).

    The same hash leaves a claim unchanged. Where the file is gone or its symbol is, the
    claim is invalidated; where the symbol moved or only the file changed, it is changed; a
    file that was being written tells nothing.
    """
    found = claims.join(files.select("path", "hash", "stable"), "path", "left").join(symbols, ["path", "symbol"], "left")
    was, now = span_text(F.col("first"), F.col("last"), F.col("line")), span_text(F.col("now_first"), F.col("now_last"), F.col("now_first"))
    whole, lost = F.col("symbol").isNull(), F.col("now_first").isNull()
    status = (
        F.when(F.col("hash").isNull(), "invalidated").when(~F.col("stable"), "unknown").when(F.col("hash") == F.col("anchor"), "unchanged").when(whole, "changed").when(lost, "invalidated").when(was == now, "unchanged").otherwise("changed")
    )
    reason = F.when(F.col("hash").isNull(), "file_removed").when(~F.col("stable"), "file_unstable").when((status == "invalidated"), "symbol_removed")
    moved = status == "changed"
    return found.select(
        "id", "task", "path", "symbol", status.alias("status"), reason.alias("reason"),
        F.when(moved & whole, "as served").when(moved, was).alias("was"), F.when(moved & whole, "file changed").when(moved, now).alias("now"),
    )


def closure(drifted: DataFrame, expected: DataFrame, touched: DataFrame) -> DataFrame:
    """Per task the states of its claims, and how many of its expected paths (task, path, role witness or consumer) were touched (task, path)."""
    state = lambda s: F.count_if(F.col("status") == s)
    claims = drifted.groupBy("task").agg(state("unchanged").alias("unchanged"), state("changed").alias("changed"), state("invalidated").alias("invalidated"), state("unknown").alias("unverifiable"))
    seen = expected.distinct().join(touched.distinct().withColumn("seen", F.lit(True)), ["task", "path"], "left")
    part = lambda role, there: F.count_if((F.col("role") == role) & (F.col("seen").isNotNull() if there else F.col("seen").isNull()))
    paths = seen.groupBy("task").agg(
        part("witness", True).alias("witnesses_observed"), part("witness", False).alias("witnesses_unobserved"), part("consumer", True).alias("consumers_inspected"), part("consumer", False).alias("consumers_not_inspected")
    )
    return claims.join(paths, "task", "full_outer").na.fill(0)
