"""Scalar functions on names, paths and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """Distinct lower-case parts of a name, of three characters or more: cut at case changes and separators."""
    # The patterns of case changes and separators.
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.transform(F.split(spaced, r"[\x00_\-.$\s]+"), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def top_segment(path: Column) -> Column:
    """The first directory of a path; null for files at the top."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))


def holding(texts: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Rows of texts whose column has a term (column term) in it, whatever the case, once for each row of terms: they meet in the term's first three characters, and then the whole term is looked for.

    Only pieces that begin some term are kept, and only they are shuffled: every executor
    gets the distinct beginnings, of three characters at most, never the pieces of all texts.
    """
    low = F.lower(column)
    pieces = F.array_distinct(F.concat(*(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3))))
    begun = terms.filter("term <> ''").withColumn("head", F.substring(F.lower("term"), 1, 3))
    met = texts.select("*", F.explode(pieces).alias("head")).join(F.broadcast(begun.select("head").distinct()), "head", "left_semi")  # beginnings, three characters at most
    # merged: the optimizer takes the pieces for as small as the texts and would gather them
    return met.hint("merge").join(begun, "head").filter(low.contains(F.lower("term"))).drop("head")


def term_hits(line: Column, terms: list[str]) -> Column:
    """How many distinct terms a line holds, whatever their case."""
    low = F.lower(line)
    return sum((low.contains(t.lower()).cast("int") for t in terms[1:]), low.contains(terms[0].lower()).cast("int"))


def with_context(lines: DataFrame, key: str, order: str, text: str, reach: int) -> DataFrame:
    """Adds before and after: arrays of the whole lines around each, fewer at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    some = lambda x: x.isNotNull()
    before = F.filter(F.array(*(F.lag(text, k).over(w) for k in range(reach, 0, -1))), some)
    return lines.withColumns({"before": before, "after": F.filter(F.array(*(F.lead(text, k).over(w) for k in range(1, reach + 1))), some)})


def best_covered(lines: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Rows of (key, line_no, line, score): per key its line with most terms, and the terms of all lines."""
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.lower(F.col("line")).contains(F.lower(t)))
    some = lines.withColumn("found", found).filter(F.size("found") > 0)
    best = F.max_by("line_no", F.struct(F.size("found"), "score", -F.col("line_no")))
    covered = sum((F.max(F.array_contains("found", t).cast("int")) for t in terms[1:]), F.max(F.array_contains("found", terms[0]).cast("int")))
    return some.groupBy(key).agg(best.alias("line_no"), F.max(F.size("found")).alias("coverage"), covered.alias("covered"))
