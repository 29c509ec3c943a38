"""Retrieval over a source tree: evidence layers, fused ranking, injection, roles and what an edit reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import code as fc
from tidemark.functions import paths as fp
from tidemark.operators import graph, retrieval
from tidemark.plans.graph_queries import COMMITS
from tidemark.plans.path_queries import BASE, DOC_SQL, EDGES, ENTRY_SQL, EXPORTS, INDEXABLE_SQL, PENALTY_SQL, TEST, TREE, VENDOR_SQL, _has
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import CODE_SQL, LINES, sql_list
from tidemark.sources.shared import written

#: Prompts and their terms.
PROMPTS = {1: ["resolveImport", "session"], 2: ["Widget", "run"], 3: ["flags", "registry"], 4: ["normalize", "gist"], 5: ["HTMLParser7", "util.spec.pem"], 6: ["index.go", "URI"], 7: ["widget12", "renderer.rst"], 8: ["parser7", "log9"]}
TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}', {k})" for q, ts in PROMPTS.items() for k, t in enumerate(ts)) + ") t(query, term, ord))"
FAN = "fan AS (SELECT to_path AS id, count(*) AS fan_in FROM edges WHERE NOT is_external AND to_path IS NOT NULL GROUP BY 1)"
TYPE_LIST = "('struct', 'class', 'protocol', 'enum', 'actor', 'typealias')"
L1 = f"""l1 AS (SELECT query, id, term, 1 AS layer, CASE WHEN kind = 'explicit' THEN 'reexport_chain' ELSE 'exported_symbol' END AS hit_type, CASE WHEN kind = 'explicit' THEN 80 ELSE 100 END AS base FROM
(SELECT t.*, e.id, e.name, e.kind, row_number() OVER (PARTITION BY query, term ORDER BY kind, e.id, name) AS place FROM terms t JOIN exports e ON lower(e.name) = lower(t.term)) LEFT JOIN fan USING (id)
WHERE place <= 50 AND (kind = 'explicit' OR contains(term, '_') OR contains(term, '.') OR regexp_matches(term, '[a-z][A-Z]') OR length(term) >= 10 OR (name = term AND NOT regexp_matches(term, '^[a-z0-9]+$')) OR coalesce(fan_in, 0) >= 5))"""
L2 = f"""l2 AS (SELECT query, id, term, 2 AS layer, CASE WHEN kind IN {TYPE_LIST} THEN 'swift_decl_type' ELSE 'swift_decl_other' END AS hit_type, CASE WHEN kind IN {TYPE_LIST} THEN 100 ELSE 80 END AS base FROM
(SELECT t.*, e.id, e.kind, row_number() OVER (PARTITION BY query, term ORDER BY kind, e.id, name) AS place FROM terms t JOIN exports e ON lower(e.name) = lower(t.term) WHERE e.kind IN ('struct', 'extension')) WHERE place <= 50)"""
L3 = "l3 AS (SELECT query, e.id, term, 3 AS layer, 'reexport_chain' AS hit_type, 80 AS base FROM terms t JOIN exports e ON lower(e.name) = lower(t.term) WHERE e.kind = 'explicit')"
SPLIT = r"regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[-_.$\s]+')"
L5 = f"""parts AS (SELECT id, name, kind, unnest(list_distinct(list_filter(list_transform({SPLIT}, lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3))) AS token FROM exports),
dfs AS (SELECT token, count(DISTINCT id) AS df FROM parts GROUP BY 1), cap AS (SELECT greatest(3, list_sort(list(df))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1]) AS cap FROM dfs),
l5 AS (SELECT query, p.id, term, 5 AS layer, CASE WHEN kind = 'explicit' THEN 'reexport_chain' ELSE 'export_token' END AS hit_type, CASE WHEN kind = 'explicit' THEN 80 ELSE 85 END AS base FROM
(SELECT t.*, p.id, p.kind, row_number() OVER (PARTITION BY query, term ORDER BY kind, p.id, name) AS place FROM terms t JOIN parts p ON p.token = lower(t.term) JOIN dfs USING (token) WHERE df <= (SELECT cap FROM cap)
AND query NOT IN (SELECT query FROM l1 UNION ALL SELECT query FROM l2 UNION ALL SELECT query FROM l3)) p JOIN tree USING (id) WHERE place <= 20 AND NOT {_has(fp.GRAPH_TESTS)})"""
L6 = rf"""held AS (SELECT query, term, t.id, t.path, count(*) OVER (PARTITION BY query, term) AS n FROM terms JOIN tree t ON contains(lower(path), lower(term))),
split AS (SELECT *, regexp_replace(string_split(lower(path), '/')[-1], '(.)\.[^.]*$', '\1') AS own, string_split(lower(path), '/')[:-2] AS folders FROM held WHERE n <= 10),
l6 AS (SELECT query, id, term, 6 AS layer, 'path_match' AS hit_type, CASE WHEN own = regexp_replace(lower(term), '^\.+|\.+$', '', 'g') OR (list_contains(folders, lower(term)) AND NOT list_contains(regexp_split_to_array(own, '[_\-.]+'), lower(term))) THEN 70 ELSE 60 END AS base FROM split)"""
BASICS = f"WITH {TERMS_SQL}, {TREE}, {EXPORTS}, {EDGES}, {FAN}"
EVERY = f"{BASICS}, {L1}, {L2}, {L3}, {L5}, {L6}"
BEST = """every AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l5 UNION ALL SELECT * FROM l6),
best AS (SELECT query, id, (list(hit_type ORDER BY base DESC, layer, ord))[1] AS hit_type, max(base) AS base, list_sort(list(DISTINCT term)) AS terms FROM every JOIN terms USING (query, term) GROUP BY 1, 2),
scored AS (SELECT b.*, path, coalesce(fan_in, 0) AS fan_in, b.base * least(0.15, ln(1 + coalesce(fan_in, 0)) * 0.02) AS part, max((hit_type IN ('exported_symbol', 'swift_decl_type'))::INTEGER) OVER (PARTITION BY query) AS defined FROM best b JOIN tree USING (id) LEFT JOIN fan USING (id)),
graph AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, fan_in DESC, path) AS rank FROM (SELECT *, CASE WHEN defined = 1 AND hit_type NOT IN ('exported_symbol', 'swift_decl_type') AND part > 0 THEN round(greatest(0.0, round(base + part, 2) - part * 0.5), 2) ELSE round(base + part, 2) END AS score FROM scored))"""


def _terms(spark):
    """Values in the plan, so their size is known and they are what is sent to the tables."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({q}, '{t}', {k})" for q, ts in PROMPTS.items() for k, t in enumerate(ts)) + " AS t(query, term, ord)")


def _fan(spark, sf_dir):
    inside = analogs.edges(spark, sf_dir).filter("not is_external and to_path is not null")
    return inside.groupBy(F.col("to_path").alias("id")).agg(F.count("*").alias("fan_in"))


def _named(terms, exports):
    """Exports whose name is a term."""
    return exports.join(terms.select(F.lower("term").alias("low")).distinct(), F.lower("name") == F.col("low"), "left_semi")


def _symbols(spark, sf_dir):
    return retrieval.symbol_layer(_terms(spark), analogs.exports(spark, sf_dir), _fan(spark, sf_dir))


def _chains(spark, sf_dir):
    return retrieval.chain_layer(_terms(spark), analogs.exports(spark, sf_dir).filter("kind = 'explicit'"))


def _early(spark, sf_dir, terms):
    """Exports, and the layers that find names; both are written, so no plan holds that of a layer before."""
    exports = written(analogs.exports(spark, sf_dir), "exports")
    named = written(_named(terms, exports), "named-exports")
    found = [retrieval.symbol_layer(terms, named, _fan(spark, sf_dir)), retrieval.declaration_layer(terms, named.filter(F.col("kind").isin("struct", "extension"))), retrieval.chain_layer(terms, named.filter("kind = 'explicit'"))]
    return exports, [written(layer, "layer") for layer in found]


def _tokens(terms, tree, exports, found):
    first = found[0].unionByName(found[1]).unionByName(found[2])
    return retrieval.token_layer(terms, exports, tree, first, written(_cap(exports), "cap"))


def _layers(spark, sf_dir, terms=None):
    terms, tree = _terms(spark) if terms is None else terms, analogs.tree(spark, sf_dir)
    exports, found = _early(spark, sf_dir, terms)
    late = [_tokens(terms, tree, exports, found), retrieval.path_layer(terms, tree)]
    return [*found, *(written(layer, "layer") for layer in late)]


def _cap(exports):
    from tidemark.functions.text import name_tokens
    from tidemark.plans.graph_queries import _cap as cap_of

    return cap_of(exports.select("id", F.explode(name_tokens(F.col("name"))).alias("token")))


COLUMNS = "query, id, term, hit_type, base"


@query(f"{BASICS}, {L1} SELECT {COLUMNS} FROM l1")
def layer_exported_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).drop("layer")


@query(f"{BASICS}, {L2} SELECT {COLUMNS} FROM l2")
def layer_declarations(spark, sf_dir):
    return retrieval.declaration_layer(_terms(spark), analogs.exports(spark, sf_dir).filter(F.col("kind").isin("struct", "extension"))).drop("layer")


@query(f"{BASICS}, {L3} SELECT {COLUMNS} FROM l3")
def layer_reexport_chain(spark, sf_dir):
    return _chains(spark, sf_dir).drop("layer")


@query(f"{BASICS}, {L1}, {L2}, {L3}, {L5} SELECT {COLUMNS} FROM l5")
def layer_export_tokens(spark, sf_dir):
    terms = _terms(spark)
    return _tokens(terms, analogs.tree(spark, sf_dir), *_early(spark, sf_dir, terms)).drop("layer")


@query(f"{BASICS}, {L6} SELECT {COLUMNS} FROM l6")
def layer_path_matches(spark, sf_dir):
    return retrieval.path_layer(_terms(spark), analogs.tree(spark, sf_dir)).drop("layer")


def _graph(spark, sf_dir, limit=10):
    return retrieval.ranked(retrieval.strongest(_layers(spark, sf_dir), _terms(spark)), analogs.tree(spark, sf_dir), _fan(spark, sf_dir), limit)


@query(f"{EVERY}, {BEST} SELECT query, path, hit_type, terms, fan_in, score, rank::INTEGER AS rank FROM graph WHERE rank <= 10")
def graph_retrieve(spark, sf_dir):
    """All layers: the strongest evidence of each file, its fan-in part, and what definitions take from the others."""
    return _graph(spark, sf_dir).drop("id")


#: What each line of the test corpus defines, told by hand.
SYMBOLS = {0: "resolveImport", 1: "flags", 2: "Widget", 3: "parse_log", 6: "run", 8: "URI", 9: "FLAG_REGISTRY", 10: "URI", 11: "run", 12: "useState", 15: "run", 16: "Widget", 20: "State", 25: "Shape", 26: "parse_log", 29: "north"}
SYMBOL_SQL = "CASE line " + " ".join("WHEN '" + LINES[k].replace("'", "''") + f"' THEN '{s}'" for k, s in SYMBOLS.items()) + " END"
WORDS = "list_filter(regexp_split_to_array(regexp_replace(line, '[^a-zA-Z0-9_]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
NOISE_SQL = f"CASE WHEN len({WORDS}) > 0 THEN len(list_filter({WORDS}, lambda w: list_contains({sql_list(fc.NOISE)}, lower(w)))) / len({WORDS}) ELSE 0.0 END"


@query(f"WITH code AS ({CODE_SQL}) SELECT line, any_value({SYMBOL_SQL}) AS symbol, round(any_value({NOISE_SQL}), 6) AS noise, count(*) AS n FROM code GROUP BY 1")
def line_symbols(spark, sf_dir):
    lines = analogs.code(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n"))
    return lines.select("line", fc.symbol(F.col("line")).alias("symbol"), F.round(fc.noise_ratio(F.col("line")), 6).alias("noise"), "n")


ASKED = {
    1: (["resolveImport"], None), 2: (["Widget", "run"], None), 3: (["URI", "extension"], None), 4: (["flags", "registry", "loadFlags"], None), 5: (["parse_log", "north"], None), 6: (["session", "value"], None), 7: (["Widget"], "Widget+Toolbar"), 8: (["Widget"], "Widget"), 9: (["URI"], "the Extension of URI"),
}
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, {sql_list(ts)}, {'NULL' if raw is None else repr(raw)})" for q, (ts, raw) in ASKED.items()) + ") t(query, terms, raw))"
LOW = "list_filter(terms, lambda t: contains(lower(line), lower(t)))"
EXACT = "(symbol IS NOT NULL AND list_contains({terms}, {symbol}))"


def _signals_sql(strict: bool) -> str:
    terms, symbol = ("terms", "symbol") if strict else ("list_transform(terms, lambda t: lower(t))", "lower(symbol)")
    export = r"(regexp_matches(line, '^\s*export\s+') OR regexp_matches(line, '^\s*(?:module\.)?exports[\s.=]') OR regexp_matches(line, '^\s*__all__\s*='))"
    return f"""(CASE WHEN {EXACT.format(terms=terms, symbol=symbol)} THEN 0.4 ELSE 0.0 END + CASE WHEN {export} AND len({LOW}) > 0 THEN 0.1 ELSE 0.0 END
+ CASE WHEN symbol IS NOT NULL AND len(list_filter({terms}, lambda t: contains({symbol}, t))) > 0 THEN 0.12 ELSE 0.0 END - CASE WHEN {NOISE_SQL} > 0.7 THEN 0.15 WHEN {NOISE_SQL} > 0.5 THEN 0.08 ELSE 0.0 END
+ CASE WHEN ends_with(path, '.py') AND regexp_matches(line, '^\\s*(async\\s+)?(def|class)\\s+[A-Za-z0-9]') AND len({LOW}) > 0 THEN 0.08 ELSE 0.0 END
+ CASE WHEN ends_with(path, '.py') AND (starts_with(line, '# how') OR starts_with(line, '\'\'\'\'\'\'docs')) AND len({LOW}) > 0 THEN 0.05 ELSE 0.0 END
+ CASE WHEN ends_with(path, '.swift') AND (len(terms) >= 2 OR contains(raw, '+') OR regexp_matches(raw, '(?i)\\bextension\\b')) AND line = 'extension Widget {{' AND list_contains(list_transform(terms, lambda t: lower(t)), 'widget') THEN 0.15 ELSE 0.0 END
+ CASE WHEN ends_with(path, '.swift') AND list_contains(list_transform(terms, lambda t: lower(t)), CASE WHEN prev IN ('class Widget(Base):', 'extension Widget {{') THEN 'widget' WHEN prev = 'public struct URI: Hashable {{' THEN 'uri' END) THEN 0.1 ELSE 0.0 END)"""


HITS_SQL = f"lined AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY line_no, line, score) AS prev FROM code), hits AS (SELECT query, terms, raw, prev, c.id, line_no, line, score, {SYMBOL_SQL} AS symbol, path FROM lined c JOIN tree USING (id), asked WHERE len({LOW}) > 0)"
CODE_CTE = f"code AS ({CODE_SQL})"


def _hits(spark, sf_dir):
    from pyspark.sql import Window

    asked = spark.createDataFrame([(q, ts, raw) for q, (ts, raw) in ASKED.items()], "query int, terms array<string>, raw string")
    before = F.lag("line").over(Window.partitionBy("id").orderBy("line_no", "line", "score"))
    return retrieval.line_hits(analogs.code(spark, sf_dir).withColumn("before", F.array_compact(F.array(before))), asked)


@query(f"""{EVERY}, {BEST}, {CODE_CTE}, {ASKED_SQL}, {HITS_SQL}, g AS (SELECT query, id, hit_type, score AS graph, fan_in FROM graph WHERE rank <= 10),
t AS (SELECT query, id, score * (1 + {_signals_sql(True)} + CASE WHEN {EXACT.format(terms='terms', symbol='symbol')} THEN 0.25 ELSE 0.0 END) + CASE WHEN len({LOW}) > 1 THEN (len({LOW}) - 1) * 15 ELSE 0 END AS points, line_no FROM hits),
b AS (SELECT query, id, max(points) AS points, (list(line_no ORDER BY points DESC, line_no))[1] AS line_no FROM t GROUP BY 1, 2),
f AS (SELECT coalesce(g.query, b.query) AS query, coalesce(g.id, b.id) AS id, hit_type, graph, points, line_no, coalesce(fan_in, 0) AS fan_in FROM g FULL JOIN b ON g.query = b.query AND g.id = b.id),
p AS (SELECT f.*, path, ({PENALTY_SQL})::DOUBLE AS penalty, coalesce(graph * 1.4, 0.0) AS own FROM f JOIN tree USING (id)),
s AS (SELECT *, round(greatest((own + coalesce(points, 0.0)) * CASE WHEN graph IS NOT NULL AND points IS NOT NULL AND hit_type <> 'reexport_chain' THEN 1.2 ELSE 1.0 END * (1 - penalty), CASE WHEN hit_type IN ('exported_symbol', 'swift_decl_type') AND penalty <> 0.25 THEN (600.0 + own) * (1 - penalty) ELSE 0.0 END), 2) AS fused FROM p)
SELECT query, path, hit_type, line_no, fan_in, fused, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, fan_in DESC, path) AS rank FROM s) WHERE rank <= 8""")
def fused_retrieve(spark, sf_dir):
    found = _graph(spark, sf_dir).select("query", "id", "hit_type", "score", "fan_in")
    return retrieval.fused(found, _hits(spark, sf_dir), analogs.tree(spark, sf_dir), 8)


HOT = """files AS (SELECT DISTINCT query, id FROM hits), placed AS (SELECT query, id, coalesce(fan_in, 0) AS fan_in, row_number() OVER (PARTITION BY query ORDER BY coalesce(fan_in, 0) DESC, id) AS n FROM files LEFT JOIN fan USING (id)),
hot AS (SELECT p.query, p.id, p.fan_in, coalesce(p.fan_in >= greatest(f.fan_in, 2), false) AS hot FROM placed p LEFT JOIN placed f ON f.query = p.query AND f.n = 5)"""


@query(f"{BASICS}, {CODE_CTE}, {ASKED_SQL}, {HITS_SQL}, {HOT} SELECT query, id, fan_in, hot FROM hot")
def hotspot_cutoff(spark, sf_dir):
    return retrieval.hot_files(_hits(spark, sf_dir), _fan(spark, sf_dir))


def _flag(holds: str, share: str) -> str:
    return f"CASE WHEN {holds} THEN {share} ELSE 0.0 END"


SITE = EXACT.format(terms="list_transform(terms, lambda t: lower(t))", symbol="lower(symbol)")
EXPORT_LINE, DEF_LINE = r"regexp_matches(line, '^\s*export\b')", r"(regexp_matches(line, '^\s*(export\s+)?(default\s+)?(async\s+)?function\b') OR regexp_matches(line, '^\s*(export\s+)?(default\s+)?class\b') OR regexp_matches(line, '^\s*export\s+(const|let|var|type|interface)\b') OR regexp_matches(line, '^\s*(async\s+)?def\s+\w+'))"
ADJUSTED = f"""parts AS (SELECT h.*, hot.fan_in, {SITE} AS site, {_flag(ENTRY_SQL, '0.1')} AS entry, {_flag('hot', '0.15')} AS hub, least(0.15, ln(1 + hot.fan_in) * 0.02) AS fan,
 0.0 - {_flag(TEST, '0.25')} - {_flag(VENDOR_SQL, '0.5')} - {_flag(DOC_SQL, '0.4')} AS role, {_flag(EXPORT_LINE, '0.05')} + {_flag(DEF_LINE, '0.03')} + {_flag(SITE, '0.25')} + {_signals_sql(False)} AS own FROM hits h JOIN hot USING (query, id)),
seen AS (SELECT *, bool_or(site) OVER (PARTITION BY query, id) AS file_site, bool_or(site) OVER (PARTITION BY query) AS query_site FROM parts),
adjusted AS (SELECT query, id, path, line_no, score, fan_in, round(greatest(0.0, greatest(0.0, score * (1 + entry + hub + fan + role + own)) - CASE WHEN query_site THEN CASE WHEN file_site THEN 0.0 ELSE score * (entry + hub + fan) * 0.5 END ELSE score * hub END), 6) AS adjusted FROM seen)"""


def _adjusted(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return retrieval.adjusted(hits, analogs.tree(spark, sf_dir), retrieval.hot_files(hits, _fan(spark, sf_dir)))


@query(f"{BASICS}, {CODE_CTE}, {ASKED_SQL}, {HITS_SQL}, {HOT}, {ADJUSTED} SELECT query, id, line_no, adjusted FROM adjusted")
def hit_adjusted_score(spark, sf_dir):
    """Every hit's score by its file's role and its line's signals, with what definition sites elsewhere take away."""
    return _adjusted(spark, sf_dir).select("query", "id", "line_no", "adjusted")


@query(f"""{BASICS}, {CODE_CTE}, {ASKED_SQL}, {HITS_SQL}, {HOT}, {ADJUSTED} SELECT query, path, line_no, adjusted, place::INTEGER AS place FROM
(SELECT *, row_number() OVER (PARTITION BY query ORDER BY adjusted DESC, id, line_no) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY adjusted DESC, line_no) AS own FROM adjusted) WHERE own <= 5) WHERE place <= 20""")
def capped_hits(spark, sf_dir):
    """The best twenty hits of each query, five of a file at most."""
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("query", "id").orderBy(F.desc("adjusted"), "line_no"))
    kept = _adjusted(spark, sf_dir).withColumn("own", own).filter("own <= 5")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("adjusted"), "id", "line_no"))
    return kept.withColumn("place", place).filter("place <= 20").select("query", "path", "line_no", "adjusted", "place")


@query(f"{BASICS}, {CODE_CTE}, {ASKED_SQL}, {HITS_SQL} SELECT query, id, max(score) AS score, (list(line_no ORDER BY score DESC, line_no))[1] AS line_no, count(*) AS hits FROM hits GROUP BY 1, 2")
def best_hit_per_file(spark, sf_dir):
    best = F.max_by("line_no", F.struct("score", -F.col("line_no")))
    return _hits(spark, sf_dir).groupBy("query", "id").agg(F.max("score").alias("score"), best.alias("line_no"), F.count("*").alias("hits"))


@query(f"{BASICS}, health AS (SELECT round(100.0 * count(*) FILTER (kind <> 'unresolved') / count(*)) AS pct FROM edges WHERE NOT is_external) SELECT id, CASE WHEN pct >= 90 THEN fan_in ELSE 0 END AS boost FROM fan, health")
def health_gate(spark, sf_dir):
    """Fan-in counts only where nine tenths of the imports are resolved."""
    health = F.broadcast(graph.resolution_stats(analogs.edges(spark, sf_dir)).select("pct"))  # one row
    return _fan(spark, sf_dir).join(health).select("id", F.when(F.col("pct") >= 90, F.col("fan_in")).otherwise(0).alias("boost"))


@query(f"""{BASICS}, {L1}, present AS (SELECT DISTINCT query, to_path AS id FROM terms, edges WHERE from_path % 8 = query), fresh AS (SELECT l1.*, ord, path, CASE WHEN {TEST} OR regexp_matches(path, '(?i)(^|/)(fixtures?|examples?|demos?|e2e|mocks?)/') THEN 0 WHEN {DOC_SQL} OR regexp_matches(path, '(?i)(^|/)docs?/') THEN 1 ELSE 2 END AS standing
FROM l1 JOIN terms USING (query, term) JOIN tree USING (id) WHERE hit_type = 'exported_symbol' AND (query, id) NOT IN (SELECT query, id FROM present WHERE id IS NOT NULL)),
b AS (SELECT query, id, path, max(standing) AS standing, (list(term ORDER BY standing DESC, ord))[1] AS term FROM fresh GROUP BY 1, 2, 3)
SELECT query, id, path, term, standing, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY standing DESC, path) AS place FROM b) WHERE place <= 10""")
def graph_injection(spark, sf_dir):
    """Files that export a term's symbol and that text search hasn't found."""
    terms = _terms(spark)
    present = analogs.edges(spark, sf_dir).select((F.col("from_path") % 8).cast("int").alias("query"), F.col("to_path").alias("id")).filter("id is not null")
    matches = _symbols(spark, sf_dir).filter("hit_type = 'exported_symbol'").join(terms, ["query", "term"]).withColumn("weight", F.lit(0))
    return retrieval.injected(matches, present, analogs.tree(spark, sf_dir), 10)


@query(f"""{BASICS}, {L3}, present AS (SELECT DISTINCT from_path % 8 AS query, to_path AS id FROM edges WHERE to_path IS NOT NULL)
SELECT query, id, place::INTEGER AS place FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS place FROM (SELECT DISTINCT query, id FROM l3) WHERE (query, id) NOT IN (SELECT query, id FROM present)) WHERE place <= 10""")
def reexport_injection(spark, sf_dir):
    from pyspark.sql import Window

    present = analogs.edges(spark, sf_dir).select((F.col("from_path") % 8).cast("int").alias("query"), F.col("to_path").alias("id"))
    fresh = _chains(spark, sf_dir).select("query", "id").distinct().join(present, ["query", "id"], "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("id"))).filter("place <= 10")


@query(f"""{EVERY}, {BEST}, r AS (SELECT *, {TEST} AS test FROM graph WHERE rank <= 10), n AS (SELECT *, sum(CASE WHEN test THEN 0 ELSE 1 END) OVER (PARTITION BY query ORDER BY rank) AS others FROM r)
SELECT query, path, rank::INTEGER AS rank, CASE WHEN test THEN 'witness' WHEN hit_type IN ('exported_symbol', 'swift_decl_type') OR others <= 3 THEN 'primary' ELSE 'support' END AS role, fan_in >= 15 AS hazard FROM n""")
def workset_roles(spark, sf_dir):
    return retrieval.roles(_graph(spark, sf_dir))


#: New files: one for each supplier, with a name and what it exports; some are there already, some no index takes.
NEW_NAMES = ["renderer.js", "flagRegistry.ts", "parseLogs.py", "sessionStateStore.ts", "widget2.js", "x.js", "normalizeAll_v2.mjs", "HTMLParser.swift", "useState.tsx", "notes.pdf", "UserApp.ts"]
NEW_SQL = f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 12 = 0 THEN (SELECT min(path) FROM tree) ELSE ['src/new/', 'lib/', 'a/node_modules/y/'][s_suppkey % 3 + 1] || s_suppkey || '/' || {sql_list(NEW_NAMES)}[s_suppkey % 11 + 1] END AS path FROM supplier"
EXPORTED_SQL = "SELECT DISTINCT s_suppkey AS id, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['resolveImport', 'ab', 'default'] WHEN 1 THEN ['run' || (s_suppkey % 40), 'widget'] WHEN 2 THEN ['URI'] ELSE []::VARCHAR[] END) AS name FROM supplier"


def _new_files(spark, sf_dir):
    k = analogs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    first = F.broadcast(analogs.tree(spark, sf_dir).agg(F.min("path").alias("first")))  # one row
    path = F.concat(analogs._pick(["src/new/", "lib/", "a/node_modules/y/"], F.col("id") % 3), F.col("id").cast("string"), F.lit("/"), analogs._pick(NEW_NAMES, F.col("id") % 11))
    texts = lambda *names: F.array(*(n if isinstance(n, F.Column) else F.lit(n) for n in names))
    n = F.col("id") % 4
    names = F.when(n == 0, texts("resolveImport", "ab", "default")).when(n == 1, texts(F.concat(F.lit("run"), (F.col("id") % 40).cast("string")), "widget")).when(n == 2, texts("URI")).otherwise(F.array().cast("array<string>"))
    return k.join(first).select("id", F.when(F.col("id") % 12 == 0, F.col("first")).otherwise(path).alias("path")), k.select("id", F.explode(names).alias("name"))


NEW_TERMS = rf"""new_files AS ({NEW_SQL}), exported AS ({EXPORTED_SQL}), fresh AS (SELECT * FROM new_files ANTI JOIN tree USING (path) WHERE {INDEXABLE_SQL}),
words AS (SELECT id, list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\.[^.]+$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z]+'), lambda w: lower(w)), lambda w: length(w) >= 3)) AS w FROM fresh),
all_terms AS (SELECT id AS query, unnest(w) AS term, 0 AS part FROM words UNION ALL SELECT id, name, 1 FROM exported SEMI JOIN fresh USING (id) WHERE length(name) >= 3 AND name <> 'default'),
terms AS (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY min(part), term) AS ord FROM all_terms GROUP BY 1, 2)"""


@query(f"""WITH {TREE}, {EXPORTS}, {EDGES}, {FAN}, {NEW_TERMS}, {L1}, {L2}, {L3}, {L5}, {L6}, {BEST}
SELECT query, path, hit_type AS reason, place::INTEGER AS place FROM (SELECT query, path, hit_type, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM graph WHERE rank <= 8 AND NOT {TEST}) WHERE place <= 3""")
def sprawl_matches(spark, sf_dir):
    """For every new file the existing ones that it may repeat."""
    new_files, exported = _new_files(spark, sf_dir)
    return retrieval.sprawl(new_files, exported, lambda terms: _layers(spark, sf_dir, terms), analogs.tree(spark, sf_dir), _fan(spark, sf_dir))


#: Every commit and every pair: an edited file's partners may be anywhere among the pairs of all files.
ALL_PAIRS = f"""WITH {COMMITS}, kept AS (SELECT hash, file FROM commits WHERE hash IS NOT NULL), occ AS (SELECT file, count(*) AS n FROM kept GROUP BY 1),
p AS (SELECT x.file AS file_a, y.file AS file_b, count(*) AS count FROM kept x JOIN kept y ON x.hash = y.hash AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 3),
pairs AS (SELECT file_a, file_b, count, round(count / least(a.n, b.n), 6) AS confidence FROM p JOIN occ a ON a.file = file_a JOIN occ b ON b.file = file_b)"""


@query(f"""{ALL_PAIRS}, {EDGES}, sessions AS (SELECT DISTINCT o_custkey AS session, l_suppkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), edits AS (SELECT session, min(id) AS id FROM sessions GROUP BY 1),
imports AS (SELECT DISTINCT to_path AS id, from_path AS other FROM edges WHERE to_path IS NOT NULL),
deps AS (SELECT e.session, e.id, count(*) AS dependents, count(*) FILTER (s.id IS NULL AND i.other <> e.id) AS untouched FROM edits e JOIN imports i USING (id) LEFT JOIN sessions s ON s.session = e.session AND s.id = i.other GROUP BY 1, 2),
ties AS (SELECT file_a AS id, file_b AS other, count, confidence FROM pairs UNION ALL SELECT file_b, file_a, count, confidence FROM pairs),
close AS (SELECT session, id, list(other ORDER BY place) AS partners FROM (SELECT e.session, e.id, b.other, row_number() OVER (PARTITION BY e.session, e.id ORDER BY confidence DESC, count DESC, b.other) AS place FROM edits e JOIN ties b ON b.id = e.id
 WHERE confidence >= 0.05 AND NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session = e.session AND s.id = b.other)) WHERE place <= 2 GROUP BY 1, 2)
SELECT coalesce(d.session, c.session) AS session, coalesce(d.id, c.id) AS id, coalesce(dependents, 0) AS dependents, coalesce(untouched, 0) AS untouched, coalesce(partners, []) AS partners FROM (SELECT * FROM deps WHERE dependents >= 3 AND untouched > 0) d FULL JOIN close c ON d.session = c.session AND d.id = c.id""")
def blast_radius(spark, sf_dir):
    orders = analogs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session"))
    items = analogs.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("id"))
    touched = written(items.join(orders.hint("merge"), "l_orderkey").select("session", "id").distinct(), "touched")
    edits = touched.groupBy("session").agg(F.min("id").alias("id"))
    ties = graph.cochange_ties(analogs.commits(spark, sf_dir), edits, min_count=3)
    return retrieval.blast_radius(edits, analogs.edges(spark, sf_dir), ties, touched, confidence=0.05)
