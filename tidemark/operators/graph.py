"""Lookups, roll-ups and traversals over import edges, files and co-changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import new_path, written

#: A node imported by more partners than this is a hub: its co-changes say little.
HUB_DEGREE = 25


def outgoing(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("from_path") == node)


def incoming(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("to_path") == node)


def unresolved_sources(edges: DataFrame, limit: int) -> DataFrame:
    return edges.filter(F.col("kind") == "unresolved").select("from_path").distinct().orderBy("from_path").limit(limit)


def neighbours(edges: DataFrame, node, limit: int) -> DataFrame:
    """Both directions, distinct, the least ids first."""
    out = outgoing(edges, node).filter("to_path is not null").select(F.lit("imports").alias("relation"), F.col("to_path").alias("path"))
    back = incoming(edges, node).select(F.lit("imported_by").alias("relation"), F.col("from_path").alias("path"))
    return out.distinct().orderBy("path").limit(limit).unionByName(back.distinct().orderBy("path").limit(limit))


def hotspots(edges: DataFrame, limit: int) -> DataFrame:
    """Most imported targets; assets count too."""
    return edges.filter("to_path is not null").groupBy(F.col("to_path").alias("path")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "path").limit(limit)


def fan_in_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, not importers, counted both ways among internal imports; 0 where there are none."""
    internal = edges.filter(~F.col("is_external"))
    fan_in = internal.groupBy(F.col("to_path").alias("id")).agg(F.count("*").alias("fan_in"))
    fan_out = internal.groupBy(F.col("from_path").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.join(fan_in, "id", "left").join(fan_out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def resolution_stats(edges: DataFrame) -> DataFrame:
    """Of internal edges only."""
    resolved = F.count_if(F.col("kind") != "unresolved")
    return edges.filter(~F.col("is_external")).agg(F.count("*").alias("total"), resolved.alias("resolved"), F.when(F.count("*") == 0, 100.0).otherwise(F.round(100 * resolved / F.count("*"))).alias("pct"))


def top_misses(edges: DataFrame, by: str, limit: int) -> DataFrame:
    return edges.filter((F.col("kind") == "unresolved") & ~F.col("is_external")).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(limit)


def type_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("type", F.lit("other")).alias("type")).agg(F.count("*").alias("n"))


def dominant_type(files: DataFrame, group: Column, limit: int) -> DataFrame:
    """Files per group and its most frequent type, the first by name where counts tie."""
    counted = files.groupBy(group.alias("dir"), "type").agg(F.count("*").alias("n"))
    return counted.groupBy("dir").agg(F.sum("n").alias("files"), F.min_by("type", F.struct(-F.col("n"), "type")).alias("dominant")).orderBy(F.desc("files"), "dir").limit(limit)


def flow_asymmetry(flows: DataFrame, minimum: float) -> DataFrame:
    """Pairs of directories by the mass between them, where one direction outweighs the other: (2 max - mass) / mass."""
    counted = flows.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    both = counted.groupBy(low.alias("low"), high.alias("high")).agg(F.sum("n").alias("mass"), F.max("n").alias("most"), F.max_by(F.col("a"), F.struct("n", "a")).alias("leads"))
    asymmetry = (2 * F.col("most") - F.col("mass")) / F.col("mass")
    return both.select("low", "high", "mass", "leads", F.round(asymmetry, 6).alias("asymmetry")).filter(asymmetry >= minimum)


def explain_group(edges: DataFrame, group_from: Column, group_to: Column, group) -> DataFrame:
    inside, outside = group_from == group, group_to == group
    return edges.agg(F.count_if(inside & outside).alias("internal"), F.count_if(~inside & outside).alias("inbound"), F.count_if(inside & ~outside).alias("outbound"))


def cochange_pairs(commits: DataFrame, *, bulk: int, min_count: int, limit: int) -> DataFrame:
    """Files that change together; commits of more than `bulk` distinct files are left out before pairing."""
    commits = commits.distinct()
    sized = commits.groupBy("hash").agg(F.count("*").alias("files")).filter(F.col("files") <= bulk).select("hash")
    kept = commits.join(sized, "hash")
    occurs = kept.groupBy("file").agg(F.count("*").alias("occ"))
    left, right = kept.withColumnRenamed("file", "file_a"), kept.withColumnRenamed("file", "file_b")
    pairs = left.join(right, "hash").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    a, b = occurs.withColumnsRenamed({"file": "file_a", "occ": "occ_a"}), occurs.withColumnsRenamed({"file": "file_b", "occ": "occ_b"})
    scored = pairs.join(a, "file_a").join(b, "file_b").select("file_a", "file_b", "count", F.round(F.col("count") / F.least("occ_a", "occ_b"), 6).alias("confidence"))
    return scored.orderBy(F.desc("count"), F.desc("confidence"), "file_a", "file_b").limit(limit)


def cochange_ties(commits: DataFrame, files: DataFrame, *, min_count: int) -> DataFrame:
    """(id, other, count, confidence): all that the given files (id) change together with, in min_count commits or more.

    Every commit counts, whatever its size, and no tie is left out for its place among all;
    only pairs without a given file aren't made. Nothing is gathered: commits are dealt by
    file to be counted, then by commit to be paired.
    """
    commits = commits.filter("hash is not null and file is not null").select("hash", "file").repartition("file").distinct()
    known = commits.join(commits.groupBy("file").agg(F.count("*").alias("occ")).hint("merge"), "file")
    given = known.join(files.select(F.col("id").alias("file")).distinct().hint("merge"), "file", "left_semi")
    left, right = given.withColumnsRenamed({"file": "id", "occ": "occ_a"}), known.withColumnsRenamed({"file": "other", "occ": "occ_b"})
    met = left.join(right.hint("merge"), "hash").filter("id <> other").groupBy("id", "other").agg(F.count("*").alias("count"), F.min(F.least("occ_a", "occ_b")).alias("occ"))
    return met.filter(F.col("count") >= min_count).select("id", "other", "count", F.round(F.col("count") / F.col("occ"), 6).alias("confidence"))


def partner_degree(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("file_a", "file_b")).alias("path")).groupBy("path").agg(F.count("*").alias("degree"))


def partners(pairs: DataFrame, node, *, hub_degree: int, limit: int) -> DataFrame:
    """A file's co-change partners, hubs left out before the limit."""
    other = F.when(F.col("file_a") == node, F.col("file_b")).otherwise(F.col("file_a"))
    own = pairs.filter((F.col("file_a") == node) | (F.col("file_b") == node)).select(other.alias("path"), "count", "confidence")
    kept = own.join(partner_degree(pairs), "path", "left").filter(F.coalesce("degree", F.lit(0)) <= hub_degree)
    return kept.select("path", "count", "confidence").orderBy(F.desc("confidence"), F.desc("count"), "path").limit(limit)


def closure(links: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """Nodes reached from the start nodes (column node) over links (a, b), with their least depth.

    Each level is written, and nodes that any level before has reached are left out, so a
    node's links are followed once, whatever the number of ways to it. Start nodes have
    depth 0; null nodes reach nothing.
    """
    spark = links.sparkSession
    links = written(links.filter("a is not null and b is not null").select("a", "b").distinct(), "links")
    path = new_path(spark, "closure")
    level = lambda depth: f"{path}/depth={depth}"
    frontier = written(start.filter("node is not null").select("node").distinct(), "", level(0))
    told = f"node {frontier.dtypes[0][1]}, depth int"
    for depth in range(1, max_depth + 1):
        reached = spark.read.schema(told).parquet(path)
        found = frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").cast(frontier.schema["node"].dataType).alias("node")).distinct()
        frontier = written(found.join(reached.select("node"), "node", "left_anti"), "", level(depth))
        if frontier.isEmpty():
            break
    return spark.read.schema(told).parquet(path)


def exports_of(exports: DataFrame, node) -> DataFrame:
    return exports.filter(F.col("id") == node).select("name", "kind").orderBy("kind", "name")


def exports_by_symbol(exports: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Exports whose name is a term, whatever its case; the first of each term by kind and file."""
    from pyspark.sql import Window

    met = exports.join(F.broadcast(terms), F.lower("name") == F.lower("term"))  # the terms of a prompt
    place = F.row_number().over(Window.partitionBy("term").orderBy("kind", "id", "name"))
    return met.withColumn("place", place).filter(F.col("place") <= limit).select("term", "id", "name", "kind")


def importers_like(edges: DataFrame, token: str, limit: int) -> DataFrame:
    return edges.filter(F.lower(F.col("specifier").cast("string")).contains(token.lower())).select("from_path").distinct().orderBy("from_path").limit(limit)


def relations_to(relations: DataFrame, target, *, kind: str | None = None, confidence: str | None = None) -> DataFrame:
    out = relations.filter(F.col("target") == target)
    for column, value in (("kind", kind), ("confidence", confidence)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out


def without_files(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after files (id) are deleted: their own rows go, edges to them lose their target."""
    left = edges.join(gone.select(F.col("id").alias("from_path")), "from_path", "left_anti")
    lost = gone.select(F.col("id").alias("to_path"), F.lit(True).alias("lost")).distinct()
    return left.join(lost, "to_path", "left").withColumn("to_path", F.when(F.col("lost"), None).otherwise(F.col("to_path"))).drop("lost")


def expanded_dirs(files: DataFrame, is_manifest: Column, packages: int) -> DataFrame:
    parts = F.split("path", "/")
    two = files.groupBy(F.element_at(parts, 1).alias("top"), F.concat_ws("/", F.slice(parts, 1, 2)).alias("two")).agg(F.count("*").alias("files"), F.max(is_manifest).alias("manifest"))
    held = two.groupBy("top").agg(F.count_if("manifest").alias("packages"))
    shown = F.when(F.col("packages") >= packages, F.col("two")).otherwise(F.col("top"))
    return two.join(held, "top").groupBy(shown.alias("dir")).agg(F.sum("files").alias("files"))


def rollup_text(rows: DataFrame, limit: int) -> DataFrame:
    """Per id its most frequent folders with their counts, as a line of text."""
    from pyspark.sql import Window

    counted = rows.groupBy("id", "dir").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id")
    placed = counted.withColumns({"place": F.row_number().over(w.orderBy(F.desc("n"), "dir")), "dirs": F.count("*").over(w)}).filter(F.col("place") <= limit)
    line = F.transform(F.array_sort(F.collect_list(F.struct("place", "dir", "n"))), lambda x: F.concat(x["dir"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return placed.groupBy("id").agg(F.concat(F.array_join(line, ", "), F.when(F.max("dirs") > limit, ", …").otherwise("")).alias("rollup"))


def notes_on(notes: DataFrame, files: list[str]) -> DataFrame:
    return notes.filter((F.size("files") == 0) | F.arrays_overlap("files", F.array(*map(F.lit, files))))
