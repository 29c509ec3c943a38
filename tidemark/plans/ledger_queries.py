"""Queries over rendered blocks, Python modules, served claims and touched files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import details
from tidemark.operators import claims, python_imports, touches
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.plans.session_queries import _resolved
from tidemark.sources import analogs, ledgers
from tidemark.sources.analogs import STEPS_SQL
from tidemark.sources.ledgers import BLOCKS_SQL, DEFINED_SQL, DEPENDENTS_SQL, MARKS_SQL, NOW_SQL, PY_SQL, SERVED_SQL, STATEMENTS_SQL, SYMBOLS_SQL, THEN_SQL

_SOURCE = "CASE " + " ".join(f"WHEN regexp_matches(trim(detail), '{p}') THEN '{s}'" for p, s in details.DETAIL_SOURCES) + " ELSE 'text_only' END"


@query(rf"""WITH l AS (SELECT id, unnest(string_split(block, chr(10))) AS raw, generate_subscripts(string_split(block, chr(10)), 1) AS k FROM ({BLOCKS_SQL})),
m AS (SELECT id, k, trim(regexp_extract(regexp_replace(raw, '\s+$', ''), '{details.SURFACED_ROW}', 1)) AS path, nullif(regexp_extract(regexp_replace(raw, '\s+$', ''), '{details.SURFACED_ROW}', 2), '') AS detail FROM l)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS place, path, {_SOURCE} AS source, try_cast(nullif(regexp_extract(detail, '{details.SURFACED_LINE}', 1), '') AS INTEGER) AS line, nullif(regexp_extract(trim(detail), '{details.DETAIL_SYMBOL}', 1), '') AS symbol FROM m WHERE path <> ''""")
def surfaced_block_rows(spark, sf_dir):
    rows = ledgers.blocks(spark, sf_dir).select("id", F.posexplode(details.surfaced_rows(F.col("block"))).alias("place", "x"))
    return rows.select("id", (F.col("place") + 1).cast("long").alias("place"), "x.*")


_SPAN = "CASE WHEN {0} IS NOT NULL THEN 'L' || {0} || CASE WHEN {1} <> {0} THEN '–' || {1} ELSE '' END WHEN {2} IS NOT NULL THEN 'L' || {2} ELSE '?' END"


@query(rf"""SELECT id, {_SPAN.format('first', 'last', 'line')} AS span, nullif(regexp_extract(note, '{details.HAZARD}', 1), '') AS hazard, replace(replace(replace(replace(replace(note, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml, replace(note, '`', '\`') AS ticks,
CASE WHEN value > 0 THEN floor(value)::BIGINT ELSE 0 END AS n, lower(folder) IN ('/tidal', 'tidal') OR ends_with(lower(folder), '-tidal') AS repo, CASE WHEN json_valid(sample) AND starts_with(sample, '[') THEN len(list_filter(json_extract_string(sample, '$[*].kind'), lambda x: x IN ('changed', 'invalidated'))) ELSE 0 END AS findings,
CASE WHEN seconds > 0 THEN strftime(DATE '1970-01-01' + (seconds // 86400)::INTEGER, '%Y-%m-%d') END AS day FROM ({MARKS_SQL})""")
def mark_scalars(spark, sf_dir):
    note = F.col("note")
    return ledgers.marks(spark, sf_dir).select(
        "id", details.span_text(F.col("first"), F.col("last"), F.col("line")).alias("span"), details.hazard_path(note).alias("hazard"), details.escape_xml(note).alias("xml"), details.escape_ticks(note).alias("ticks"),
        details.finite_count(F.col("value")).alias("n"), details.repo_matches(F.col("folder"), "/tidal").alias("repo"), details.sample_count(F.col("sample")).cast("long").alias("findings"), details.iso_date(F.col("seconds")).alias("day"),
    )


_SPECIFIERS = f"SELECT DISTINCT importer, CASE WHEN statement = 'import' THEN module ELSE repeat('.', level) || coalesce(module, '') END AS specifier, CASE WHEN statement = 'import' THEN 'import' WHEN level > 0 THEN 'relative' ELSE 'from' END AS kind FROM ({STATEMENTS_SQL})"


@query(_SPECIFIERS)
def python_specifiers(spark, sf_dir):
    return python_imports.specifiers(ledgers.statements(spark, sf_dir))


@query(f"""WITH d AS ({DEFINED_SQL}), l AS (SELECT *, unnest(listed) AS name FROM d) SELECT id, name, CASE WHEN list_contains(classes, name) THEN 'class' WHEN list_contains(functions, name) THEN 'function' WHEN list_contains(constants, name) THEN 'const' ELSE 'explicit' END AS kind FROM l
UNION ALL SELECT id, unnest(functions), 'function' FROM d WHERE listed IS NULL UNION ALL SELECT id, unnest(classes), 'class' FROM d WHERE listed IS NULL UNION ALL SELECT id, unnest(constants), 'const' FROM d WHERE listed IS NULL""")
def python_public_names(spark, sf_dir):
    return python_imports.public_names(ledgers.defined(spark, sf_dir))


def _file(path: str) -> str:
    return f"CASE WHEN {path} IN (SELECT path FROM py) THEN {path} END"


@query(rf"""WITH py AS ({PY_SQL}), a AS (SELECT DISTINCT importer, specifier, regexp_replace(specifier, '^\.+', '') AS name, string_split(importer, '/') AS f FROM ({_SPECIFIERS})), b AS (SELECT *, length(specifier) - length(name) AS level FROM a),
c AS (SELECT *, CASE WHEN level = 0 THEN replace(name, '.', '/') WHEN length(f) >= level THEN trim(coalesce(array_to_string(f[1:length(f) - level], '/'), '') || '/' || replace(name, '.', '/'), '/') END AS base, split_part(name, '.', 1) AS top FROM b),
d AS (SELECT importer, specifier, level, CASE WHEN name = '' THEN {_file("ltrim(base || '/__init__.py', '/')")} ELSE coalesce({_file("base || '.py'")}, {_file("base || '/__init__.py'")}, {_file('base')}) END AS inside, {_file("top || '/__init__.py'")} AS package, {_file("top || '.py'")} AS module FROM c),
e AS (SELECT importer, specifier, level, CASE WHEN specifier = '' THEN NULL WHEN level > 0 OR package IS NOT NULL THEN inside ELSE module END AS to_path FROM d)
SELECT importer, specifier, to_path, CASE WHEN specifier = '' OR level > 0 AND to_path IS NULL THEN 'unresolved' WHEN level > 0 THEN 'relative' WHEN to_path IS NULL THEN 'external' ELSE 'local' END AS kind FROM e""")
def python_resolved(spark, sf_dir):
    return python_imports.resolved(python_imports.specifiers(ledgers.statements(spark, sf_dir)).select("importer", "specifier"), ledgers.python_files(spark, sf_dir))


_CLAIMS = f"SELECT 'c_' || substr(sha1(s.path || '|' || coalesce(symbol, '') || '|' || coalesce(line::VARCHAR, '')), 1, 10) AS id, task, s.path, symbol, first, last, line, CASE WHEN symbol IS NOT NULL THEN 'defines' WHEN first IS NOT NULL THEN 'region_at' ELSE 'relevant' END AS predicate, hash AS anchor FROM ({SERVED_SQL}) s JOIN ({THEN_SQL}) t ON t.path = s.path"
_DRIFT = f"""SELECT *, CASE WHEN status = 'changed' AND symbol IS NULL THEN 'as served' WHEN status = 'changed' THEN before END AS was, CASE WHEN status = 'changed' AND symbol IS NULL THEN 'file changed' WHEN status = 'changed' THEN after END AS now,
CASE WHEN gone THEN 'file_removed' WHEN status = 'unknown' THEN 'file_unstable' WHEN status = 'invalidated' THEN 'symbol_removed' END AS reason FROM (SELECT *, CASE WHEN gone THEN 'invalidated' WHEN NOT stable THEN 'unknown' WHEN hash = anchor THEN 'unchanged' WHEN symbol IS NULL THEN 'changed' WHEN now_first IS NULL THEN 'invalidated' WHEN before = after THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT c.*, n.hash, n.stable, n.hash IS NULL AS gone, y.now_first, {_SPAN.format('first', 'last', 'line')} AS before, {_SPAN.format('now_first', 'now_last', 'now_first')} AS after FROM ({_CLAIMS}) c LEFT JOIN ({NOW_SQL}) n ON n.path = c.path LEFT JOIN ({SYMBOLS_SQL}) y ON y.path = c.path AND y.symbol = c.symbol))"""


@query(_CLAIMS)
def minted_claims(spark, sf_dir):
    return claims.minted(ledgers.served(spark, sf_dir), ledgers.snapshots(spark, sf_dir)[0])


def _drifted(spark, sf_dir):
    then, now, symbols = ledgers.snapshots(spark, sf_dir)
    return claims.drift(claims.minted(ledgers.served(spark, sf_dir), then), now, symbols)


@query(f"SELECT id, task, path, symbol, status, reason, was, now FROM ({_DRIFT})")
def claim_drift(spark, sf_dir):
    return _drifted(spark, sf_dir)


_ROLE = "CASE WHEN symbol IS NULL THEN 'consumer' ELSE 'witness' END"


def _states(names: list[tuple[str, str]]) -> str:
    return ", ".join(f"count(*) FILTER ({when}) AS {name}" for name, when in names)


@query(f"""WITH c AS (SELECT task, {_states([(n, f"status = '{s}'") for n, s in (("unchanged", "unchanged"), ("changed", "changed"), ("invalidated", "invalidated"), ("unverifiable", "unknown"))])} FROM ({_DRIFT}) GROUP BY 1),
t AS (SELECT DISTINCT l_suppkey AS task, 'f' || (l_orderkey % 97) AS path FROM lineitem), x AS (SELECT DISTINCT task, path, {_ROLE} AS role FROM ({SERVED_SQL})),
p AS (SELECT task, {_states([(f"{r}_{w}", f"role = '{k}' AND t.path IS {n} NULL") for r, k, a, b in (("witnesses", "witness", "observed", "unobserved"), ("consumers", "consumer", "inspected", "not_inspected")) for w, n in ((a, "NOT"), (b, ""))])} FROM x LEFT JOIN t USING (task, path) GROUP BY 1)
SELECT task, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("unchanged", "changed", "invalidated", "unverifiable", "witnesses_observed", "witnesses_unobserved", "consumers_inspected", "consumers_not_inspected"))} FROM c FULL JOIN p USING (task)""".replace("t.path IS", "t.seen IS").replace("AS path FROM lineitem), x", "AS path, true AS seen FROM lineitem), x"))
def task_closure(spark, sf_dir):
    expected = ledgers.served(spark, sf_dir).select("task", "path", F.when(F.col("symbol").isNull(), "consumer").otherwise("witness").alias("role"))
    touched = analogs.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string")).alias("path"))
    return claims.closure(_drifted(spark, sf_dir), expected, touched)


@query(f"""WITH t AS (SELECT sid, ord, path FROM ({STEPS_SQL}) WHERE kind = 'open'), f AS (SELECT sid, path AS dependent, min(ord) AS touched FROM t GROUP BY 1, 2)
SELECT sid, dependent, ord, path FROM t JOIN ({DEPENDENTS_SQL}) d USING (path) LEFT JOIN f USING (sid, dependent) WHERE touched IS NULL OR touched > ord QUALIFY row_number() OVER (PARTITION BY sid, dependent ORDER BY ord, path) = 1""")
def untouched_dependents(spark, sf_dir):
    return touches.untouched_dependents(analogs.steps(spark, sf_dir).filter("kind = 'open'").select("sid", "ord", "path"), ledgers.dependents(spark, sf_dir))


CHANGED = ["lib/core/m0/renderer.mjs", "src/m1/index.js"]


@query(f"SELECT DISTINCT importer FROM ({ORACLE_SQL['resolved_imports']}) WHERE (kind = 'unresolved' OR to_path IN {tuple(CHANGED)} OR contains(lower(specifier), 'renderer') OR contains(lower(specifier), 'index') OR contains(lower(specifier), 'm1')) AND importer NOT IN {tuple(CHANGED)}")
def repair_importers(spark, sf_dir):
    return touches.repair_set(_resolved(spark, sf_dir), CHANGED, most=10_000_000)


@query(f"""WITH steps AS ({STEPS_SQL}), s AS (SELECT sid, path, ord, slot * 10 AS line, source FROM steps WHERE kind = 'inject' QUALIFY row_number() OVER (PARTITION BY sid, path, ord ORDER BY slot, source) = 1), e AS (SELECT *, count(*) OVER (PARTITION BY sid ORDER BY ord) AS n FROM steps WHERE kind = 'open'),
j AS (SELECT e.sid, e.path, e.ord AS id, s.ord AS shown, s.source, s.line BETWEEN e.slot * 5 AND e.slot * 5 + 20 AS hit, e.n FROM e ASOF JOIN s ON e.sid = s.sid AND e.path = s.path AND e.ord >= s.ord WHERE e.tool = 'Edit' AND e.ord % 7 > 0 QUALIFY row_number() OVER (PARTITION BY e.sid, e.path, s.ord ORDER BY e.ord) = 1)
SELECT sid, path, id, source, hit, n - (SELECT count(*) FROM e WHERE e.sid = j.sid AND e.ord < j.shown) AS opens FROM j""")
def edits_of_surfaced(spark, sf_dir):
    """Every seventh edit's lines aren't known."""
    steps = analogs.steps(spark, sf_dir)
    opens = steps.filter("kind = 'open'")
    results = opens.select(F.col("ord").alias("id"), F.lit(0).alias("at"), "path", F.when(F.col("ord") % 7 > 0, F.col("slot") * 5).cast("int").alias("first"), (F.col("slot") * 5 + 20).cast("int").alias("last"))
    surfaced = steps.filter("kind = 'inject'").select("sid", "ord", "path", (F.col("slot") * 10).cast("int").alias("line"), "source")
    return touches.edits_of_surfaced(surfaced, opens.select("sid", "ord", F.col("ord").alias("id"), "tool"), results)
