"""Functions and classes of source files, the one that holds a line, and its body.

Blocks come from the depth of lines: in Python how far a line is indented, elsewhere how many
braces are open. A definition's block ends before the next line that is no deeper. One
pass over each file's lines in order keeps the definitions that are open, so a file may be
of any length. Strings and comments that one line holds don't count; those over several
lines aren't told from code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package

#: Extensions that have scopes, lines of a body, words that no method is named.
PYTHON, BRACED = ["py"], ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"]
MOST_LINES = 200
NO_METHOD = "if for while switch catch function class return throw try else do".split()
#: Patterns of definitions.
PYTHON_FUNCTION, PYTHON_CLASS = r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", r"^\s*class\s+(\w+)"
CLASS, FUNCTION = r"\bclass\s+([A-Za-z_$][A-Za-z0-9_$]*)\b", r"\b(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
ARROW = r"\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][A-Za-z0-9_$]*)\s*=>\s*\{"
METHOD = r"^\s*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
#: Cells of lines in which hits and scopes meet.
CELL = 64

SCOPES = "path string, name string, kind string, first long, last long"


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def marked(lines: DataFrame) -> DataFrame:
    """Adds what the pass needs: python, code (nothing but code), depth (spaces before a Python line), opens and closes (braces), ends (a statement), and the definition's name and kind."""
    python = _extension(F.col("path")).isin(PYTHON)
    bare = F.regexp_replace("line", r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|/\*.*?\*/", '""')
    code = F.when(python, F.regexp_replace(bare, r"#.*$", "")).otherwise(F.regexp_replace(bare, r"//.*$", ""))
    rows = lines.filter(_extension(F.col("path")).isin(PYTHON + BRACED)).select("path", "line_no", python.alias("python"), F.coalesce(code, F.lit("")).alias("code"))
    first = lambda *found: F.coalesce(*(F.when(name != "", F.struct(name.alias("name"), F.lit(kind).alias("kind"))) for name, kind in found))
    of = lambda pattern: F.regexp_extract("code", pattern, 1)
    method = F.when(of(METHOD).isin(NO_METHOD), "").otherwise(of(METHOD))
    defined = F.when(F.col("python"), first((of(PYTHON_FUNCTION), "function"), (of(PYTHON_CLASS), "class"))).otherwise(first((of(CLASS), "class"), (of(FUNCTION), "function"), (of(ARROW), "function"), (method, "method")))
    count = lambda c: F.length("code") - F.length(F.replace("code", F.lit(c), F.lit("")))
    blank = F.trim(F.regexp_replace("code", r"\s", "")) == ""
    return rows.select("path", "line_no", "python", blank.alias("blank"), F.length(F.regexp_extract("code", r"^\s*", 0)).alias("depth"), count("{").alias("opens"), count("}").alias("closes"), F.col("code").contains(";").alias("ends"), defined.alias("defined")).select("*", "defined.name", "defined.kind").drop("defined")


class _File:
    """One file's open definitions: (name, kind, first line, depth, whether its block has begun)."""

    def __init__(self):
        self.open: list[list] = []
        self.depth = self.last = 0
        self.python = True

    def take(self, r) -> list[tuple]:
        if r.blank:
            return []
        out = []
        self.python = r.python
        if r.python:
            while self.open and self.open[-1][3] >= r.depth:
                name, kind, first, *_ = self.open.pop()
                out.append((name, kind, first, self.last))
            if r.name is not None:
                inside = bool(self.open) and self.open[-1][1] == "class"
                self.open.append([r.name, "method" if inside and r.kind == "function" else r.kind, r.line_no, r.depth, True])
        else:
            if r.name is not None:
                self.open.append([r.name, r.kind, r.line_no, self.depth, False])
            self.depth += r.opens - r.closes
            for o in self.open:
                o[4] = o[4] or r.opens > 0 and (self.depth > o[3] or r.opens == r.closes)
            while self.open and self.open[-1][4] and self.depth <= self.open[-1][3]:
                name, kind, first, *_ = self.open.pop()
                out.append((name, kind, first, r.line_no))
            # a statement ends, or very many lines pass, before the block begins: there is none
            self.open = [o for o in self.open if o[4] or not (r.ends and not r.opens) and r.line_no - o[2] < MOST_LINES]
        self.last = r.line_no
        return out

    def finish(self) -> list[tuple]:
        return [(name, kind, first, self.last) for name, kind, first, *_ in self.open] if self.python else []


def scopes(lines: DataFrame) -> DataFrame:
    """(path, name, kind, first, last) of lines (path, line_no, line); a brace that is never closed makes no scope."""
    ship_package(lines.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, held = None, _File()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.path != path:
                    out += [(path, *x) for x in held.finish()]
                    path, held = r.path, _File()
                out += [(path, *x) for x in held.take(r)]
            yield pd.DataFrame(out, columns=["path", "name", "kind", "first", "last"])
        yield pd.DataFrame([(path, *x) for x in held.finish()], columns=["path", "name", "kind", "first", "last"])

    return marked(lines).repartition("path").sortWithinPartitions("path", "line_no").mapInPandas(run, SCOPES)


def enclosing(hits: DataFrame, found: DataFrame, mode: str = "function") -> DataFrame:
    """Adds to hits (path, line_no) the scope that holds each: in mode function the smallest function or method, in mode class the smallest class, else the smallest of all; nulls where there is none.

    Scopes and hits meet in cells of lines, so that a file's hits don't meet all its scopes.
    """
    cells = found.select("path", "name", "kind", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))).alias("cell"))
    points = hits.select("path", "line_no").distinct().withColumn("cell", F.floor(F.col("line_no") / CELL))
    met = points.join(cells, ["path", "cell"]).filter("first <= line_no and line_no <= last")
    wanted = F.col("kind").isin("class") if mode == "class" else F.col("kind").isin("function", "method")
    best = met.groupBy("path", "line_no").agg(F.min_by(F.struct("name", "kind", "first", "last"), F.struct(~wanted, F.col("last") - F.col("first"), -F.col("first"), "name")).alias("scope"))
    return hits.join(best, ["path", "line_no"], "left")


def with_body(hits: DataFrame, lines: DataFrame, *, most: int = MOST_LINES) -> DataFrame:
    """Adds to hits with a scope its lines, at most so many from its first, whether that cuts it, and the hit's place in it."""
    size = F.col("scope.last") - F.col("scope.first") + 1
    spans = hits.filter("scope is not null").select("path", F.col("scope.first").alias("first"), F.col("scope.last").alias("last")).distinct()
    wanted = spans.select("path", "first", "last", F.explode(F.sequence(F.col("first"), F.least("last", F.col("first") + most - 1))).alias("line_no"))
    bodies = wanted.join(lines.select("path", "line_no", "line"), ["path", "line_no"]).groupBy("path", "first", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("body"))
    keyed = hits.withColumns({"first": F.col("scope.first"), "last": F.col("scope.last")})
    return keyed.join(bodies, ["path", "first", "last"], "left").withColumns({"truncated": size > most, "place": F.col("line_no") - F.col("first")}).drop("first", "last")
