"""Text search over lines of files: literal or regular expression, smart case, sources before other files, with a posting table of trigrams in front."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import patterns

#: Extensions of sources, which are searched first, and folders at the root that aren't searched.
SOURCE_EXTENSIONS = "js jsx ts tsx mts cts mjs cjs py go rs rb java kt c cpp h hpp cs swift lua ex exs erl hs scala clj php pl r".split()
SKIPPED = [".planning", "node_modules", ".git", "dist", "build", ".next"]
#: Hits of a search, and lines around each.
MAX_HITS, CONTEXT_LINES = 50, 1
#: Lines of a file that share their postings.
BLOCK_LINES = 64


@dataclass(frozen=True)
class Query:
    id: int
    pattern: str
    literal: bool = False

    @property
    def regex(self) -> str:
        """A pattern without upper-case characters of its own matches any case."""
        own = re.escape(self.pattern) if self.literal else self.pattern
        return own if patterns.has_upper(self.pattern, self.literal) else f"(?iu){own}"

    @property
    def needs(self) -> patterns.Need:
        own = re.escape(self.pattern) if self.literal else self.pattern
        need = patterns.required(own)
        return [] if frozenset() in need else need


def is_searched(path: Column) -> Column:
    """Not in a skipped folder of the root, and no part of the path is hidden."""
    return ~F.split(path, "/")[0].isin(SKIPPED) & ~path.rlike(r"(^|/)\.[^/]")


def is_source(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1).isin(SOURCE_EXTENSIONS)


def unit(block_lines: int) -> Column:
    """The block that a line's postings are kept for; two blocks under one number only cost reading."""
    return F.xxhash64("path", F.floor((F.col("line_no") - 1) / block_lines))


def postings(lines: DataFrame, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(gram, unit): which blocks of lines (path, line_no, line) hold which lower-case trigrams of printable ASCII.

    Meant to be written once, see write_postings; the lines searched later have to be the same.
    """
    held = F.regexp_extract_all(F.lower("line"), F.lit("(?=([ -~]{3}))"), F.lit(1))
    return lines.filter(is_searched(F.col("path"))).select(unit(block_lines).alias("unit"), F.explode(F.array_distinct(held)).alias("gram")).distinct().select("gram", "unit")


def write_postings(lines: DataFrame, path: str, *, block_lines: int = BLOCK_LINES) -> None:
    """Sorted by gram, so that a search reads only the row groups of the grams it asks for."""
    postings(lines, block_lines=block_lines).repartitionByRange("gram").sortWithinPartitions("gram", "unit").write.parquet(path)


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(query, unit): blocks that hold all trigrams of one of a query's alternatives. Queries that require none have no rows."""
    rows = [(q.id, k, g, len(alternative)) for q in queries for k, alternative in enumerate(q.needs) for g in sorted(alternative)]
    needed = index.sparkSession.createDataFrame(rows, "query int, alternative int, gram string, needed int")
    asked = index.filter(F.col("gram").isin(sorted({r[2] for r in rows})))
    met = asked.join(needed, "gram").groupBy("query", "alternative", "needed", "unit").agg(F.count("*").alias("met"))
    return met.filter(F.col("met") == F.col("needed")).select("query", "unit").distinct()


def _chosen(lines: DataFrame, index: DataFrame | None, queries: list[Query], block_lines: int) -> DataFrame:
    """Adds asked, the numbers of the queries for which a line has to be read."""
    searched = lines.filter(is_searched(F.col("path")) & F.col("line").isNotNull())
    free = F.array(*(F.lit(q.id) for q in queries if index is None or not q.needs)).cast("array<int>")
    if index is None:
        return searched.withColumn("asked", free)
    by_unit = candidates(index, queries).groupBy("unit").agg(F.collect_set("query").alias("held"))
    how = "left" if any(not q.needs for q in queries) else "inner"
    met = searched.withColumn("unit", unit(block_lines)).join(by_unit, "unit", how)
    return met.withColumn("asked", F.concat(free, F.coalesce("held", F.array().cast("array<int>")))).drop("unit", "held")


def lines_read(lines: DataFrame, index: DataFrame, queries: list[Query], *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(query, lines): how many lines each query reads; those that no query reads aren't there."""
    return _chosen(lines, index, queries, block_lines).select(F.explode("asked").alias("query")).groupBy("query").agg(F.count("*").alias("lines"))


def _ranges(line: Column, regex: str) -> Column:
    """Where the pattern matches, in bytes: the texts between the matches, and the matches, one after the other."""
    between, found = F.split(line, regex, -1), F.regexp_extract_all(line, F.lit(regex), F.lit(0))
    sizes = lambda xs: F.transform(xs, lambda x: F.octet_length(x))
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + x)
    starts = F.transform(found, lambda x, i: total(sizes(between), i + 1) + total(sizes(found), i))
    return F.transform(F.arrays_zip(starts.alias("start"), sizes(found).alias("size")), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end")))


def search(lines: DataFrame, queries: list[Query], *, index: DataFrame | None = None, max_hits: int = MAX_HITS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The first hits of each query by path and line, those in sources before all others.

    lines: path, line_no, line. Without an index every line is read once for all queries;
    with one, the lines of the blocks that can match. Returns query, path, line_no, line,
    source, ranges (bytes, of matches that aren't empty) and rank.
    """
    line, parts = F.col("line"), F.split("path", "/")
    read = _chosen(lines, index, queries, block_lines)
    own = F.array_compact(F.array(*(F.when(F.array_contains("asked", q.id) & line.rlike(q.regex), F.lit(q.id)) for q in queries)))
    hits = read.select("path", "line_no", "line", F.explode(own).alias("query")).withColumn("source", is_source(F.col("path")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("source"), parts, "line_no"))
    kept = hits.withColumn("rank", place).filter(F.col("rank") <= max_hits)
    ranges = F.coalesce(*(F.when(F.col("query") == q.id, _ranges(line, q.regex)) for q in queries))
    return kept.select("query", "path", "line_no", "line", "source", ranges.alias("ranges"), "rank")


def with_lines_around(hits: DataFrame, lines: DataFrame, reach: int = CONTEXT_LINES) -> DataFrame:
    """Adds before and after, the lines around each hit; hits are few, so their neighbours are looked up."""
    near = hits.select("query", "path", F.col("line_no").alias("hit_no"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off")).filter("off <> 0").withColumn("line_no", F.col("hit_no") + F.col("off"))
    found = near.join(lines.select("path", "line_no", "line"), ["path", "line_no"]).groupBy("query", "path", F.col("hit_no").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("off", "line"))).alias("near"))
    side = lambda before: F.transform(F.filter(F.coalesce("near", F.array()), lambda x: (x["off"] < 0) == before), lambda x: x["line"])
    return hits.join(found, ["query", "path", "line_no"], "left").withColumns({"before": side(True), "after": side(False)}).drop("near")
