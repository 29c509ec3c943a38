"""Queries over sessions of surfaced and opened paths, over imports of sources, and over evaluated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths as fp
from tidemark.operators import evaluation, imports, sessions
from tidemark.plans.event_queries import _wilson_sql
from tidemark.plans.path_queries import TEST
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources import analogs
from tidemark.sources.analogs import CASES_SQL, CONFIG_SQL, IMPORTS_SQL, LOG_SQL, PACKAGES_SQL, SOURCE_SQL, STEPS_SQL, TREE_SQL

STEPS = f"steps AS ({STEPS_SQL})"
FOUND = f"""{STEPS}, o AS (SELECT sid, path, ord, row_number() OVER (PARTITION BY sid ORDER BY ord) AS at FROM steps WHERE kind = 'open'), t AS (SELECT sid, count(*) AS total FROM o GROUP BY 1),
i AS (SELECT s.sid, s.ord, s.slot, any_value(s.path) AS path, any_value(s.mode) AS mode, any_value(s.source) AS source, count(o.at) AS opens FROM steps s LEFT JOIN o ON o.sid = s.sid AND o.ord < s.ord WHERE s.kind = 'inject' GROUP BY 1, 2, 3),
f AS (SELECT i.sid, i.ord, i.slot, i.path, i.mode, i.source, i.opens, any_value(coalesce(t.total, 0)) AS total, coalesce(bool_or(o.at > i.opens), false) AS after, coalesce(bool_or(o.at <= i.opens), false) AS before, min(o.at - i.opens) FILTER (o.at BETWEEN i.opens + 1 AND i.opens + 8) AS touch
  FROM i LEFT JOIN t USING (sid) LEFT JOIN o ON o.sid = i.sid AND (o.path = i.path OR ends_with(o.path, '/' || i.path)) GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
INJECTIONS = f"{FOUND}, j AS (SELECT sid, mode, ord, count(*) AS surfaced, count(*) FILTER (after) AS opened, min(touch) AS touch, min(touch) IS NULL AND max(total) > max(opens) AS missed FROM f GROUP BY 1, 2, 3)"
_SUMS = "count(*) AS injections, sum(surfaced)::BIGINT AS surfaced, sum(opened)::BIGINT AS opened"
_TRIES = "(count(touch) + count(*) FILTER (missed))"


def _pct(part: str, whole: str) -> str:
    return f"round(100 * {part} / nullif({whole}, 0), 1)"


def _found(spark, sf_dir):
    return sessions.matched(analogs.steps(spark, sf_dir))


@query(f"WITH {INJECTIONS} SELECT sid, mode, {_SUMS}, count(touch) AS touched, count(*) FILTER (missed) AS missed FROM j GROUP BY 1, 2")
def session_scores(spark, sf_dir):
    return sessions.session_scores(_found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT sid, ord, slot, after, before, touch FROM f")
def first_touches(spark, sf_dir):
    return _found(spark, sf_dir).select("sid", "ord", "slot", "after", "before", "touch")


@query(f"WITH {INJECTIONS} SELECT mode, {_SUMS}, {_pct('sum(opened)', 'sum(surfaced)')} AS coverage_pct, {_TRIES} AS tries, count(touch) AS touched, {_pct('count(touch)', _TRIES)} AS touched_pct, {_pct('count(*) FILTER (touch = 1)', _TRIES)} AS first_pct, quantile_disc(touch, 0.5) AS median_touch FROM j GROUP BY 1")
def session_corpus(spark, sf_dir):
    return sessions.corpus(_found(spark, sf_dir))


@query(f"""WITH {FOUND}, r AS (SELECT mode, source, count(*) AS surfaced, count(*) FILTER (after) AS opened FROM f GROUP BY 1, 2) SELECT *, {_pct('opened', 'surfaced')} AS coverage_pct, round({_wilson_sql('opened', 'surfaced', '-')}, 6) AS low, round({_wilson_sql('opened', 'surfaced', '+')}, 6) AS high FROM r""")
def source_coverage(spark, sf_dir):
    return sessions.by_source(_found(spark, sf_dir))


@query(f"""WITH {FOUND}, r AS (SELECT source, count(*) AS surfaced, count(*) FILTER (after) AS opened FROM f GROUP BY 1), m AS (SELECT sum(opened) / sum(surfaced) AS mean FROM r WHERE surfaced >= 30)
SELECT source, surfaced, opened, round(CASE WHEN surfaced < 30 OR coalesce(mean, 0) = 0 THEN 1.0 ELSE greatest(0.7, least(1.3, opened / surfaced / mean)) END, 6)::DOUBLE AS prior FROM r, m""")
def source_priors(spark, sf_dir):
    return sessions.priors(_found(spark, sf_dir))


@query(f"""WITH {FOUND} SELECT source, count(*) AS instances, count(DISTINCT sid || ':' || path) AS files, count(*) FILTER (after) AS after, count(*) FILTER (before AND NOT after) AS before_only, count(touch) AS within, {_pct('count(*) FILTER (after)', 'count(*)')} AS after_pct, {_pct(f'count(*) FILTER ({TEST})', 'count(*)')} AS test_pct FROM f GROUP BY 1""")
def surfacing_report(spark, sf_dir):
    return sessions.surfacings(_found(spark, sf_dir), fp.is_test_path(F.col("path")))


@query(f"WITH {FOUND} SELECT source, slot, count(*) AS n FROM f GROUP BY 1, 2")
def surfacing_ranks(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("source", "slot").agg(F.count("*").alias("n"))


@query(f"""WITH {FOUND}, c AS (SELECT source, path, count(*) AS n, count(*) FILTER (after) AS opened FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, path) AS place FROM c QUALIFY place <= 8""")
def most_surfaced(spark, sf_dir):
    return sessions.most_surfaced(_found(spark, sf_dir))


@query(f"""WITH {STEPS}, o AS (SELECT *, regexp_extract(path, '^[^/]+/[^/]+') AS folder, row_number() OVER (PARTITION BY sid ORDER BY ord) AS rank FROM steps WHERE kind = 'open' AND NOT starts_with(path, '/')),
e AS (SELECT sid, folder, count(*) AS n FROM o WHERE tool = 'Edit' GROUP BY 1, 2), w AS (SELECT sid, folder AS site, n AS most, sum(n) OVER (PARTITION BY sid) AS edits, row_number() OVER (PARTITION BY sid ORDER BY n DESC, folder) AS rn FROM e),
r AS (SELECT sid, count(*) AS opens, min(rank) FILTER (folder = site) AS rank FROM o JOIN w USING (sid) WHERE rn = 1 AND edits >= 2 AND most / edits >= 0.5 GROUP BY 1 HAVING opens >= 3), s AS (SELECT list_sort(list(rank)) AS ranks, count(*) AS sessions, count(*) FILTER (rank > 1) AS wrong FROM r)
SELECT sessions, wrong, ranks[sessions // 2 + 1] AS median_rank, ranks[floor(sessions * 0.9)::BIGINT + 1] AS p90_rank, {_pct('wrong', 'sessions')} AS wrong_pct FROM s""")
def wrong_starts(spark, sf_dir):
    return sessions.wrong_starts(analogs.steps(spark, sf_dir), F.regexp_extract("path", "^[^/]+/[^/]+", 0))


@query(f"WITH log AS ({LOG_SQL}) SELECT sid, name, source, arm, count(*) AS n FROM log GROUP BY 1, 2, 3, 4")
def event_volume(spark, sf_dir):
    return analogs.log(spark, sf_dir).groupBy("sid", "name", "source", "arm").agg(F.count("*").alias("n"))


def _extracted(patterns: list[tuple[str, str]]) -> list[str]:
    return [f"SELECT id, unnest(regexp_extract_all(code, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS found, '{kind}' AS kind FROM code" for kind, p in patterns]


_CODE = f"code AS (SELECT id, regexp_replace(regexp_replace(source, '{imports.BLOCK_COMMENT}', '', 'g'), '{imports.LINE_COMMENT}', '', 'g') AS code FROM ({SOURCE_SQL}))"
_LISTED = r"SELECT id, unnest(string_split(regexp_extract(m, '\{([^}]*)\}', 1), ',')) AS item FROM (SELECT id, unnest(regexp_extract_all(code, '\bexport\s*\{\s*[^}]+\s*\}(?:\s*from)?')) AS m FROM code) WHERE NOT ends_with(m, 'from')"


@query(f"WITH {_CODE} SELECT id, found AS specifier, kind FROM ({' UNION '.join(_extracted(imports.IMPORTS))})")
def import_specifiers(spark, sf_dir):
    return imports.import_rows(analogs.sources(spark, sf_dir))


@query(rf"""WITH {_CODE}, listed AS ({_LISTED}) SELECT id, found AS name, kind FROM ({' UNION '.join(_extracted(imports.EXPORTS))} UNION SELECT id, trim(regexp_replace(trim(item), '^.*\s+as\s+', '')), 'named' FROM listed WHERE trim(item) <> ''
UNION SELECT id, 'default', 'default' FROM code WHERE regexp_matches(code, '{imports.DEFAULT}') UNION SELECT id, 'default', 'cjs-default' FROM code WHERE regexp_matches(code, '{imports.WHOLE}'))""")
def source_exports(spark, sf_dir):
    return imports.export_rows(analogs.sources(spark, sf_dir))


_FILE = "SELECT id, list_sort(list(DISTINCT kind || ' ' || {0})) AS found, count(*) AS n FROM ({1}) GROUP BY 1"


def _by_file(rows, column):
    return rows.groupBy("id").agg(F.array_sort(F.collect_set(F.concat("kind", F.lit(" "), column))).alias("found"), F.count("*").alias("n"))


@query(_FILE.format("specifier", ORACLE_SQL["import_specifiers"]))
def file_imports(spark, sf_dir):
    """What each whole source imports, as one list."""
    return _by_file(imports.import_rows(analogs.sources(spark, sf_dir)), "specifier")


@query(_FILE.format("name", ORACLE_SQL["source_exports"]))
def file_exports(spark, sf_dir):
    """What each whole source exports, as one list."""
    return _by_file(imports.export_rows(analogs.sources(spark, sf_dir)), "name")


@query(f"WITH {_CODE} SELECT found AS specifier, count(*) AS files FROM ({' UNION '.join(_extracted(imports.IMPORTS))}) WHERE kind = 'export-from' GROUP BY 1")
def reexport_targets(spark, sf_dir):
    return imports.import_rows(analogs.sources(spark, sf_dir)).filter("kind = 'export-from'").groupBy("specifier").agg(F.count("*").alias("files"))


#: A path's candidates, written out: extensions, then index files; what a written extension is compiled from.
PROBES = "list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.json'], lambda x: base || x) || list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.json'], lambda x: base || '/index' || x)"
COMPILED = """CASE ext WHEN '.js' THEN [stem || '.ts', stem || '.tsx'] WHEN '.jsx' THEN [stem || '.tsx', stem || '.ts'] WHEN '.mjs' THEN [stem || '.mts', stem || '.ts'] WHEN '.cjs' THEN [stem || '.cts', stem || '.ts'] ELSE [] END"""
ASSET = r"(contains(specifier, '?') OR contains(specifier, '#') OR regexp_matches(specifier, '\.(css|scss|sass|less|styl|png|jpe?g|gif|webp|svg|ico|bmp|tiff|woff2?|ttf|otf|eot|mp4|webm|mov|mp3|wav)$'))"
#: A path with its dots taken out, by letting each .. take one part back from the left; null where it leaves the root.
FLAT = """list_reduce([[]::VARCHAR[]] || list_transform(list_filter(string_split({0}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x]), lambda a, x: CASE WHEN a IS NULL THEN NULL WHEN x[1] <> '..' THEN a || x WHEN len(a) > 0 THEN a[1:len(a) - 1] END)"""


@query(rf"""WITH tree AS ({TREE_SQL}), imports AS ({IMPORTS_SQL}), configs AS ({CONFIG_SQL}), base_url AS (SELECT arg_min(base_url, level) AS base_url FROM configs WHERE base_url IS NOT NULL),
listed AS (SELECT level, k, paths[k].pattern AS pattern, paths[k].targets AS targets FROM configs, unnest(range(1, len(paths) + 1)) t(k)), aliases AS (SELECT pattern, arg_min(targets, level) AS targets, max(level) AS deep, arg_max(k, level) AS place FROM listed GROUP BY 1),
bare AS (SELECT * FROM imports WHERE specifier <> '' AND NOT starts_with(specifier, 'node:') AND NOT {ASSET} AND NOT starts_with(specifier, '.') AND NOT starts_with(specifier, '/')),
by_alias AS (SELECT importer, specifier, 1 AS way, -deep AS a, place AS b, j AS c, CASE WHEN NOT starts_with(targets[j], '/') THEN base_url || '/' || CASE WHEN contains(pattern, '*') THEN replace(targets[j], '*', specifier[length(pattern):]) ELSE targets[j] END END AS raw
 FROM bare JOIN aliases ON specifier = pattern OR (ends_with(pattern, '/*') AND starts_with(specifier, pattern[:-2]) AND length(specifier) >= length(pattern)), base_url, unnest(range(1, len(targets) + 1)) t(j)),
packages AS (SELECT name, max(dir) AS dir, count(*) AS n FROM ({PACKAGES_SQL}) WHERE regexp_matches(dir, '^(lib/core/[^/]*|src(/.*)?)$') GROUP BY 1), entries AS (SELECT p.name, p.dir, list_filter([q.module, q.main, q.types, 'src/index.ts', 'src/index.tsx', 'src/index.js', 'index.ts', 'index.js'], lambda x: x IS NOT NULL) AS entries FROM packages p JOIN ({PACKAGES_SQL}) q USING (name, dir)),
named AS (SELECT *, CASE WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE split_part(specifier, '/', 1) END AS name FROM bare),
inside AS (SELECT *, CASE WHEN specifier = name THEN entries ELSE [trim(specifier[length(name) + 1:], '/')] END AS paths FROM named JOIN entries USING (name)),
by_package AS (SELECT importer, specifier, 2 AS way, j AS a, 0 AS b, 0 AS c, dir || '/' || paths[j] AS raw FROM inside, unnest(range(1, len(paths) + 1)) t(j)),
local AS (SELECT importer, specifier, 0 AS way, 0 AS a, 0 AS b, 0 AS c, CASE WHEN starts_with(specifier, '/') THEN specifier ELSE array_to_string(string_split(importer, '/')[:-2], '/') || '/' || regexp_extract(specifier, '^[^?#]*') END AS raw FROM imports WHERE {ASSET} OR starts_with(specifier, '.') OR starts_with(specifier, '/')),
tried AS (SELECT *, array_to_string({FLAT.format('raw')}, '/') AS base FROM (SELECT * FROM local UNION ALL SELECT * FROM by_alias UNION ALL SELECT * FROM by_package) WHERE raw IS NOT NULL),
e AS (SELECT *, lower(regexp_extract(base, '[^/](\.[^./]*)$', 1)) AS ext, regexp_matches(lower(importer), '[^/]\.(ts|tsx|mts|cts)$') AS typed FROM tried WHERE base IS NOT NULL), s AS (SELECT *, base[1:length(base) - length(ext)] AS stem FROM e),
l AS (SELECT *, [base] || CASE WHEN ext = '' THEN {PROBES} WHEN typed THEN {COMPILED} ELSE [] END AS found FROM s), c2 AS (SELECT importer, specifier, way, a, b, c, found[j] AS path, j AS place FROM l, unnest(range(1, len(found) + 1)) t(j)),
h AS (SELECT importer, specifier, path AS to_path, way FROM c2 SEMI JOIN tree USING (path) QUALIFY row_number() OVER (PARTITION BY importer, specifier ORDER BY way, a, b, c, place) = 1)
SELECT importer, specifier, to_path, CASE WHEN specifier = '' THEN 'unresolved' WHEN starts_with(specifier, 'node:') THEN 'external' WHEN {ASSET} THEN 'asset' WHEN starts_with(specifier, '.') THEN CASE WHEN to_path IS NULL THEN 'unresolved' ELSE 'relative' END
 WHEN starts_with(specifier, '/') THEN CASE WHEN to_path IS NULL THEN 'unresolved' ELSE 'root' END WHEN way = 1 THEN 'tsconfig' WHEN way = 2 THEN 'workspace' ELSE 'external' END AS kind FROM imports LEFT JOIN h USING (importer, specifier)""")
def resolved_imports(spark, sf_dir):
    """Imports of all kinds: relative, root, asset, through path aliases and workspace packages, external and unresolved."""
    return _resolved(spark, sf_dir).select("importer", "specifier", "to_path", "kind")


def _resolved(spark, sf_dir):
    workspaces = spark.createDataFrame([(0, w) for w in analogs.WORKSPACES], "repo int, glob string")
    packages = imports.workspace_packages(analogs.packages(spark, sf_dir), workspaces)
    return imports.resolved(analogs.imports(spark, sf_dir), analogs.tree(spark, sf_dir), imports.path_aliases(analogs.configs(spark, sf_dir)), packages)


_USE = """CASE WHEN negative THEN CASE WHEN ranked = 0 THEN 1.0 ELSE 0.0 END ELSE 0.3 * CASE WHEN primary_rank = 0 THEN 1.0 WHEN primary_rank <= 2 THEN 0.7 WHEN primary_rank <= 9 THEN 0.4 ELSE 0.0 END
+ 0.3 * greatest(0.0, least(1.0, CASE WHEN good_hits THEN 1.0 ELSE 0.2 END - warnings * 0.1 + CASE WHEN exact THEN 0.1 ELSE 0.0 END)) + 0.2 * coalesce(p_on, 0) + 0.2 * CASE WHEN NOT graph THEN 0.5 WHEN related = 0 THEN 0.0 WHEN lib_related > 0 THEN 1.0 ELSE 0.5 END END::DOUBLE"""


def _mean(c: str) -> str:
    return f"coalesce(avg({c}) FILTER (NOT negative), 0)"


@query(f"WITH cases AS ({CASES_SQL}) SELECT id, round({_USE}, 6)::DOUBLE AS usefulness FROM cases")
def case_usefulness(spark, sf_dir):
    return analogs.cases(spark, sf_dir).select("id", F.round(evaluation.usefulness(), 6).alias("usefulness"))


@query(f"""WITH cases AS ({CASES_SQL}) SELECT count(*) AS cases, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed, round({_mean('p_on')}, 6) AS mean_precision, round({_mean('mrr')}, 6) AS mean_mrr, round({_mean('n_on')}, 6) AS mean_ndcg, round({_mean(_USE)}, 6) AS mean_usefulness,
round({_mean('p_on')} - {_mean('p_off')}, 6) AS lift_precision, round({_mean('n_on')} - {_mean('n_off')}, 6) AS lift_ndcg, CASE WHEN {_mean('n_on')} - {_mean('n_off')} > 0.01 THEN 'positive' WHEN {_mean('n_on')} - {_mean('n_off')} < -0.01 THEN 'negative' ELSE 'neutral' END AS direction,
count(*) FILTER (NOT negative AND n_on - n_off < -0.05) AS breaches FROM cases""")
def eval_aggregates(spark, sf_dir):
    return evaluation.aggregates(analogs.cases(spark, sf_dir))
