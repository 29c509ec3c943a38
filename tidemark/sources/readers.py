"""Readers of source trees, git logs, event logs, transcripts and search responses.

Places in a file are (block, n): the start of the file's split and the row's number in it,
so that rows keep their order when a large file is read by many tasks.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What `git log --pretty=format:%x01COMMIT%x01%H --name-only` puts before a commit; a source's largest size.
COMMIT, MOST_BYTES = "\x01COMMIT\x01", 512 * 1024
RESPONSE = "Result struct<Files: array<struct<FileName: string, Score: double, LineMatches: array<struct<Line: string, LineNumber: long, FileName: boolean>>>>>"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "n": F.monotonically_increasing_id()})


def scan_tree(spark: SparkSession, root: str, names: list[str], ignored: str = r"/(node_modules|\.git)/", previous: DataFrame | None = None) -> DataFrame:
    """(path, mtime, size, source) of the files below root whose names match one of the globs, but for hidden and ignored ones.

    A source larger than 512 KiB is null. With the rows of a previous scan, files of equal
    path, mtime and size are left out before any of them is read: the folders are listed
    without contents, and only what is left is opened. Names of changed files pass through
    the driver, as those of all files do wherever Spark lists a folder.
    """
    listed = _files(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").format("binaryFile").load(root), root, ignored)
    if previous is not None:
        changed = listed.drop("content").join(previous.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti").select("file")
        files = [re.sub(r"([\\{}\[\]*?^,])", r"\\\1", r["file"]) for r in changed.toLocalIterator()]
        listed = _files(spark.read.format("binaryFile").load(files), root, ignored) if files else listed.filter(F.lit(False))
    return listed.select("path", "mtime", "size", F.when(F.col("size") <= MOST_BYTES, F.col("content").cast("string")).alias("source"))


def _files(found: DataFrame, root: str, ignored: str) -> DataFrame:
    below = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split(":")[-1] + r"\E/", "")
    rows = found.select(F.col("path").alias("file"), below.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.filter(~F.concat(F.lit("/"), "path").rlike(r"/\.") & ~F.concat(F.lit("/"), "path").rlike(ignored))


def commits_of_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, files) of a git log, a row for each commit; the mark before a commit parts the rows, so that a log is read by many tasks."""
    parts = spark.read.option("lineSep", COMMIT).text(path).select(_lines(F.col("value")).alias("lines")).filter(F.size("lines") > 0)
    return parts.select(F.element_at("lines", 1).alias("hash"), F.slice("lines", 2, F.size("lines")).alias("files"))


def recent_files(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """(file, ts): the files that a log of `%ct` and names touched last."""
    parts = spark.read.option("lineSep", "\n\n").text(path).select(_lines(F.col("value")).alias("lines")).filter(F.element_at("lines", 1).rlike(r"^\d{9,}$"))
    touched = parts.select(F.element_at("lines", 1).cast("long").alias("ts"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("file"))
    return touched.groupBy("file").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "file").limit(most)


def file_changes(spark: SparkSession, path: str) -> DataFrame:
    """(hash, block, n, place, status, file): files that commits of a `--name-status` log add or delete, in the log's order."""
    parts = _placed(spark.read.option("lineSep", COMMIT).text(path)).select("block", "n", _lines(F.col("value")).alias("lines")).filter(F.size("lines") > 0)
    named = parts.select(F.element_at("lines", 1).alias("hash"), "block", "n", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("place", "line"))
    return named.select("hash", "block", "n", "place", F.substring_index("line", "\t", 1).alias("status"), F.substring_index("line", "\t", -1).alias("file")).filter(F.col("status").isin("A", "D"))


def read_events(spark: SparkSession, path: str, schema: str, *, with_old: bool = True) -> DataFrame:
    """Events of a JSON log, of its rotated generation (`.old`) too, which comes first; lines that aren't JSON are left out.

    generation, block and n give the order.
    """
    rows = _placed(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path + "{,.old}" if with_old else path))
    return rows.withColumn("generation", F.when(F.col("file").endswith(".old"), 0).otherwise(1)).drop("file")


def pooled_events(spark: SparkSession, roots: dict[str, str], schema: str, exposed: list[str]) -> DataFrame:
    """The logs of several roots with a column root; `coherence.` events only of exposed roots. ts, root and the place give the order."""
    one = [read_events(spark, path, schema).withColumn("root", F.lit(root)) for root, path in roots.items()]
    return reduce(DataFrame.unionByName, one).filter(~F.col("name").startswith("coherence.") | F.col("root").isin(exposed))


def transcripts(spark: SparkSession, root: str, *, nested: bool = False) -> DataFrame:
    """(file, block, n, record) of all `.jsonl` files below root; those of subagents and workflows only if nested."""
    rows = _placed(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)).withColumnRenamed("value", "record").filter("record <> ''")
    return rows if nested else rows.filter(~F.col("file").rlike("/(subagents|workflows)/"))


def transcript_markers(rows: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Per file and record type the number of records, and whether any record holds each marker."""
    kind = F.coalesce(F.get_json_object("record", "$.type"), F.lit("(none)"))
    return rows.groupBy("file", kind.alias("type")).agg(F.count("*").alias("records"), *(F.max(F.col("record").contains(text)).alias(name) for name, text in markers.items()))


def search_hits(responses: DataFrame, dropped: Column) -> DataFrame:
    """(path, line_no, line, score) of search responses in a column response; whole files for which dropped (over path) holds give none, nor do matches of names."""
    parsed = responses.select(F.from_json("response", RESPONSE).alias("r")).select(F.explode("r.Result.Files").alias("f")).select(F.col("f.FileName").alias("path"), F.col("f.Score").alias("score"), F.explode("f.LineMatches").alias("m"))
    kept = parsed.filter(~dropped & ~F.coalesce("m.FileName", F.lit(False)))
    return kept.select("path", F.col("m.LineNumber").alias("line_no"), F.rtrim(F.unbase64("m.Line").cast("string")).alias("line"), "score")


def health_history(snapshots: DataFrame, most: int = 100, shown: int = 20) -> DataFrame:
    """Per root of snapshots (root, ts, resolution, files): number, first and last time of the latest ones kept, and the trends of the last shown."""
    late = snapshots.withColumn("back", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("ts")))).filter(F.col("back") <= most)
    trend = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= shown, F.struct("ts", F.coalesce(c, F.lit(0)).alias("v"))))), lambda x: x.v)
    return late.groupBy("root").agg(F.count("*").alias("kept"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), trend("resolution").alias("resolution_trend"), trend("files").alias("files_trend"))
