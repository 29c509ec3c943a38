"""Text search with postings against a full scan, and what patterns require."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import as_rows
from tidemark.functions import patterns
from tidemark.operators import search
from tidemark.operators.search import Query

PIECES = ["foo", "bar", "a.c", "(ab|cd|)", "x*", "[a-c]d", "o{2}", "ba?r", "^", "$", "\\w+", "(?:foo|bar)+", "(?=ba)", "Z", "é", "[^a]", ".", "fo{1,3}", "\\.", "(a|b)(c|d)"]


@given(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), st.text("abcdfoorx.Zé ", max_size=30))
@settings(max_examples=600, deadline=None)
def test_what_matches_meets_a_requirement(pattern, text):
    needs = patterns.required(pattern)
    if re.search(pattern, text, re.I):
        assert any(all(g in text.lower() for g in alternative) for alternative in needs)


@pytest.mark.parametrize("pattern, wanted", [
    ("abcd", [{"abc", "bcd"}]), ("ab", [set()]), ("ab.cd", [set()]), ("(abc|de)", [set()]), ("(abc|def)x", [{"abc", "bcx"}, {"def", "efx"}]), ("abc|def", [{"abc"}, {"def"}]),
    ("abc.*def", [{"abc", "def"}]), ("(abc)+", [{"abc"}]), ("(abc)*d", [set()]), ("ABC", [{"abc"}]), ("ab[xy]", [{"abx"}, {"aby"}]), ("abé", [set()]), (r"\p{L}abc", [set()]), ("a(?i:BC)d", [{"abc", "bcd"}]), ("a{3,}", [{"aaa"}]), ("(ab){1,9}c", [set()]), ("(ab){2}c", [{"aba", "bab", "abc"}]), ("abc(?=x)d", [{"abc", "bcd"}]),
])
def test_requirements(pattern, wanted):
    assert sorted(map(sorted, patterns.required(pattern))) == sorted(map(sorted, wanted))


def test_smart_case():
    upper = [p for p, literal in [("abc", False), ("aBc", False), (r"\Sab\W", False), (r"\Sab", True), ("é", False), ("É", False), ("[A-Z]", False)] if patterns.has_upper(p, literal)]
    assert upper == ["aBc", r"\Sab", "É", "[A-Z]"]


LINES = [
    ("src/a.py", 1, "Alpha beta gamma"), ("src/a.py", 2, "alpha é beta"), ("src/a.py", 70, "the alphabet"), ("README", 1, "ALPHA"), ("docs/x.md", 3, "alphaalpha"), ("node_modules/a.js", 1, "alpha"), ("lib/node_modules/a.js", 1, "alpha"),
    ("src/.hidden/a.py", 1, "alpha"), (".gitignore", 1, "alpha"), ("a/b.py", 1, None), ("a/b.py", 2, ""), ("a/b.py", 3, "x" * 5000 + "alpha" + "y" * 5000), ("a.b/c.py", 1, "alpha"), ("src/a.py.txt", 1, "a+b (alpha)"), ("src/A.PY", 1, "alpha"),
]
ASKED = [Query(1, "alpha"), Query(2, "Alpha"), Query(3, "a+b (", literal=True), Query(4, "a|é"), Query(5, "(alpha){2}|y{40}$"), Query(6, "^$"), Query(7, "never found")]


def plain(max_hits):
    out = []
    for q in ASKED:
        rx = re.compile(re.escape(q.pattern) if q.literal else q.pattern, 0 if patterns.has_upper(q.pattern, q.literal) else re.I)
        found = []
        for path, n, line in LINES:
            parts = path.split("/")
            if line is None or parts[0] in search.SKIPPED or any(p.startswith(".") for p in parts) or not rx.search(line):
                continue
            source = "." in parts[-1] and parts[-1].rsplit(".", 1)[1] in search.SOURCE_EXTENSIONS
            spans = [(len(line[: m.start()].encode()), len(line[: m.end()].encode())) for m in rx.finditer(line) if m.end() > m.start()]
            found.append((not source, parts, n, path, line, source, spans))
        out += [(q.id, path, n, line, source, spans, k) for k, (_, _, n, path, line, source, spans) in enumerate(sorted(found)[:max_hits], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_hits", [50, 2])
def test_search_equals_a_scan(spark, tmp_path, max_hits):
    lines = spark.createDataFrame(LINES, "path string, line_no long, line string").repartition(4)
    path = str(tmp_path / "postings")
    search.write_postings(lines, path, block_lines=2)
    for index in (None, search.postings(lines, block_lines=2), spark.read.parquet(path)):
        hits = search.search(lines, ASKED, index=index, max_hits=max_hits, block_lines=2)
        got = [(r["query"], r["path"], r["line_no"], r["line"], r["source"], [tuple(x) for x in r["ranges"] if x["end"] > x["start"]], r["rank"]) for r in hits.collect()]
        assert sorted(got, key=repr) == plain(max_hits)
    read = {r["query"]: r["lines"] for r in search.lines_read(lines, spark.read.parquet(path), ASKED, block_lines=2).collect()}
    searched = [x for x in LINES if x[2] is not None and x[0].split("/")[0] not in search.SKIPPED and not re.search(r"(^|/)\.", x[0])]
    assert read[6] == read[4] == len(searched) and read[1] < len(searched) and read[5] < read[1] and 7 not in read


def test_lines_around(spark):
    lines = spark.createDataFrame([("a", n, f"l{n}") for n in range(1, 6)], "path string, line_no long, line string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (2, "b", 1)], "query int, path string, line_no long")
    got = as_rows(["query", "path", "line_no", "before", "after"], [tuple(r) for r in search.with_lines_around(hits, lines, 2).select("query", "path", "line_no", "before", "after").collect()])
    assert got == as_rows(["query", "path", "line_no", "before", "after"], [(1, "a", 1, [], ["l2", "l3"]), (1, "a", 3, ["l1", "l2"], ["l4", "l5"]), (2, "b", 1, [], [])])
    assert search.with_lines_around(hits.limit(0), lines).count() == 0


def test_postings_are_pruned(spark, tmp_path):
    lines = spark.createDataFrame(LINES, "path string, line_no long, line string")
    search.write_postings(lines, str(tmp_path / "p"))
    plan = search.candidates(spark.read.parquet(str(tmp_path / "p")), ASKED)._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "BroadcastNestedLoopJoin" not in plan
    assert search.postings(lines.filter(F.lit(False))).count() == 0
