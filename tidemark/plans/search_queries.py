"""Text search over the lines of a corpus of files, with postings of trigrams in front."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scopes, search
from tidemark.operators.search import Query
from tidemark.plans.registry import query
from tidemark.sources.corpus import CODE_SQL, LINES_SQL, code_lines, lines

QUERIES = [
    Query(1, "Apache License", literal=True), Query(2, "licen[sc]ed? under"), Query(3, r"\b(MIT|GNU) [A-Z]\w+"), Query(4, r"[\w.]+@\w+\.(com|org|net)"), Query(5, "^the .*thing"),
    Query(6, "the&&&", literal=True), Query(7, r"^.{1,4}$"), Query(8, "ción"), Query(9, r"(st){2}and|er\.er+"), Query(10, "b.le", literal=True), Query(11, r"\BING\b"),
]
#: The same as a table, written out: query, pattern of the SQL dialect.
ASKED_SQL = r"""asked(query, pattern) AS (VALUES (1, 'Apache License'), (2, '(?i)licen[sc]ed? under'), (3, '\b(MIT|GNU) [A-Z]\w+'), (4, '(?i)[\w.]+@\w+\.(com|org|net)'), (5, '(?i)^the .*thing'),
 (6, '(?i)the&&&'), (7, '(?i)^.{1,4}$'), (8, '(?i)ción'), (9, '(?i)(st){2}and|er\.er+'), (10, '(?i)b\.le'), (11, '\BING\b'))"""
SEARCHED = "searched AS (SELECT * FROM lines WHERE NOT regexp_matches(path, '^(\\.planning|node_modules|\\.git|dist|build|\\.next)/') AND NOT regexp_matches(path, '(^|/)\\.[^/]'))"
IS_SOURCE = "regexp_matches(path, '\\.(js|jsx|ts|tsx|mts|cts|mjs|cjs|py|go|rs|rb|java|kt|c|cpp|h|hpp|cs|swift|lua|ex|exs|erl|hs|scala|clj|php|pl|r)$')"
FOUND = f"""WITH lines AS ({LINES_SQL}), {SEARCHED}, {ASKED_SQL}, found AS (SELECT query, pattern, path, line_no, line, {IS_SOURCE} AS source FROM searched, asked WHERE regexp_matches(line, pattern)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY source DESC, string_split(path, '/'), line_no) AS rank FROM found)"""
#: Matches and the texts between them give the places of the matches.
STARTS = "list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(b[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0))::INTEGER)"
ENDS = "list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(b[1:i], lambda x: strlen(x))) + list_sum(list_transform(m[1:i], lambda x: strlen(x))))::INTEGER)"


@query(f"""{FOUND}, cut AS (SELECT *, regexp_extract_all(line, pattern) AS m, string_split_regex(line, pattern) AS b FROM placed WHERE rank <= 50)
SELECT query, path, line_no, line, source, {STARTS} AS starts, {ENDS} AS ends, rank::INTEGER AS rank FROM cut""")
def text_search(spark, sf_dir):
    """Literal and regular expressions, any case where the pattern has no upper case, fifty hits each, sources first."""
    corpus = lines(spark, sf_dir)
    hits = search.search(corpus, QUERIES, index=search.postings(corpus, block_lines=4), block_lines=4)
    return hits.withColumns({"starts": F.col("ranges.start"), "ends": F.col("ranges.end")}).drop("ranges")


@query(f"""{FOUND}, hits AS (SELECT * FROM placed WHERE rank <= 50)
SELECT query, h.path, h.line_no, h.rank::INTEGER AS rank, coalesce(list(l.line ORDER BY l.line_no) FILTER (l.line_no < h.line_no), []) AS before, coalesce(list(l.line ORDER BY l.line_no) FILTER (l.line_no > h.line_no), []) AS after
FROM hits h JOIN lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 1 GROUP BY ALL""")
def text_search_context(spark, sf_dir):
    """The line before and after each hit."""
    corpus = lines(spark, sf_dir)
    hits = search.search(corpus, QUERIES, index=search.postings(corpus, block_lines=4), block_lines=4)
    return search.with_lines_around(hits, corpus).select("query", "path", "line_no", "rank", "before", "after")


#: What each pattern requires, told by hand: query, alternative, trigram. Pattern 7 requires nothing, 8 too few characters that are ASCII.
NEEDS = {
    1: [["apa", "pac", "ach", "che", "he ", "e l", " li", "lic", "ice", "cen", "ens", "nse"]],
    2: [
        ["lic", "ice", "cen", "ens", "nse", "se ", "e u", " un", "und", "nde", "der"], ["lic", "ice", "cen", "ens", "nse", "sed", "ed ", "d u", " un", "und", "nde", "der"],
        ["lic", "ice", "cen", "enc", "nce", "ce ", "e u", " un", "und", "nde", "der"], ["lic", "ice", "cen", "enc", "nce", "ced", "ed ", "d u", " un", "und", "nde", "der"],
    ],
    3: [["mit", "it "], ["gnu", "nu "]], 4: [[".co", "com"], [".or", "org"], [".ne", "net"]], 5: [["the", "he ", "thi", "hin", "ing"]], 6: [["the", "he&", "e&&", "&&&"]],
    9: [["sts", "tst", "sta", "tan", "and"], ["er.", "r.e"]], 10: [["b.l", ".le"]], 11: [["ing"]],
}
NEEDS_SQL = "needs(query, alternative, gram) AS (VALUES " + ", ".join(f"({q}, {k}, '{g}')" for q, xs in NEEDS.items() for k, x in enumerate(xs) for g in x) + ")"


@query(f"""WITH lines AS ({LINES_SQL}), {SEARCHED}, {NEEDS_SQL}, sized AS (SELECT query, alternative, count(*) AS needed FROM needs GROUP BY 1, 2),
met AS (SELECT DISTINCT query, alternative, gram, path, (line_no - 1) // 4 AS block FROM searched JOIN needs ON contains(lower(line), gram)),
whole AS (SELECT DISTINCT query, path, block FROM (SELECT query, alternative, path, block, count(*) AS n FROM met GROUP BY ALL) JOIN sized USING (query, alternative) WHERE n = needed)
SELECT query, count(*) AS lines FROM searched s JOIN whole w ON s.path = w.path AND (s.line_no - 1) // 4 = w.block GROUP BY 1
UNION ALL SELECT q, (SELECT count(*) FROM searched) FROM (VALUES (7), (8)) t(q)""")
def search_lines_read(spark, sf_dir):
    """How many lines a search reads where postings rule the other blocks out."""
    corpus = lines(spark, sf_dir)
    return search.lines_read(corpus, search.postings(corpus, block_lines=4), QUERIES, block_lines=4)

#: Ends of blocks by comparing lines of a file: the next line that is no deeper, or the line where as few braces are open as before.
SCOPES = rf"""code AS ({CODE_SQL}), py AS (SELECT path, line_no, line, length(regexp_extract(line, '^ *')) AS depth FROM code WHERE ends_with(path, '.py') AND trim(line) <> '' AND NOT starts_with(trim(line), '#')),
py_defs AS (SELECT path, line_no AS first, depth, coalesce(nullif(regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)', 1), ''), regexp_extract(line, '^\s*class\s+(\w+)', 1)) AS name, CASE WHEN contains(line, 'class') THEN 'class' ELSE 'function' END AS kind FROM py WHERE regexp_matches(line, '^\s*(async\s+def|def|class)\s')),
py_next AS (SELECT d.path, d.first, d.name, d.kind, (SELECT min(l.line_no) FROM py l WHERE l.path = d.path AND l.line_no > d.first AND l.depth <= d.depth) AS after FROM py_defs d),
py_scopes AS (SELECT n.path, n.first, n.name, n.kind, (SELECT max(l.line_no) FROM py l WHERE l.path = n.path AND (n.after IS NULL OR l.line_no < n.after)) AS last FROM py_next n),
py_named AS (SELECT s.path, s.name, CASE WHEN s.kind = 'function' AND (SELECT arg_max(p.kind, p.first) FROM py_scopes p WHERE p.path = s.path AND p.first < s.first AND p.last >= s.first) = 'class' THEN 'method' ELSE s.kind END AS kind, s.first, s.last FROM py_scopes s),
braced AS (SELECT path, line_no, line, CASE WHEN contains(line, '{{') THEN 1 ELSE 0 END AS opens, CASE WHEN contains(line, '}}') AND NOT contains(line, '''') THEN 1 ELSE 0 END AS closes FROM code WHERE ends_with(path, '.ts')),
depths AS (SELECT *, sum(opens - closes) OVER (PARTITION BY path ORDER BY line_no) AS depth FROM braced),
b_defs AS (SELECT path, line_no AS first, depth - (opens - closes) AS before, CASE line WHEN 'class A {{' THEN 'A' WHEN 'function f(x) {{' THEN 'f' WHEN 'const g = (y) => {{' THEN 'g' WHEN 'm(a) {{' THEN 'm' END AS name FROM depths),
b_scopes AS (SELECT d.path, d.name, CASE name WHEN 'A' THEN 'class' WHEN 'm' THEN 'method' ELSE 'function' END AS kind, d.first, (SELECT min(l.line_no) FROM depths l WHERE l.path = d.path AND l.line_no > d.first AND l.depth <= d.before) AS last FROM b_defs d WHERE name IS NOT NULL),
scopes AS (SELECT * FROM py_named UNION ALL SELECT * FROM b_scopes WHERE last IS NOT NULL)"""


@query(f"WITH {SCOPES} SELECT path, name, kind, first, last FROM scopes")
def code_scopes(spark, sf_dir):
    """Functions, methods and classes with the lines they span, by indentation or braces."""
    return scopes.scopes(code_lines(spark, sf_dir))


@query(f"""WITH {SCOPES}, hits AS (SELECT path, line_no FROM code WHERE contains(line, 'x')), met AS (SELECT h.path, h.line_no, name, kind, first, last FROM hits h LEFT JOIN scopes s ON s.path = h.path AND line_no BETWEEN first AND last),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY path, line_no ORDER BY (kind = 'class')::INTEGER, last - first, first DESC, name) = 1)
SELECT b.path, b.line_no, name, kind, b.line_no - first AS place, list(c.line ORDER BY c.line_no) FILTER (c.line IS NOT NULL) AS body, last - first + 1 > 12 AS truncated FROM best b LEFT JOIN code c ON c.path = b.path AND c.line_no BETWEEN first AND least(last, first + 11) GROUP BY ALL""")
def hit_scopes(spark, sf_dir):
    """The function around each line that holds an x, or the class where there is none, with its first twelve lines."""
    rows = code_lines(spark, sf_dir)
    hits = rows.filter(F.col("line").contains("x")).select("path", "line_no")
    told = scopes.with_body(scopes.enclosing(hits, scopes.scopes(rows)), rows, most=12)
    return told.select("path", "line_no", "scope.name", "scope.kind", "place", "body", "truncated")
