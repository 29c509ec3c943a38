"""Exposure windows and snapshot lifetimes over a log, and the snapshots that are listed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import coherence
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.sources.analogs import _pick, table
from tidemark.streaming import exposures, lifetimes

KINDS = ["open", "read", "mutation", "open", "read", "read", "mutation", "open", "close", "prompt"]


def _rows(spark, sf_dir):
    """Sessions of suppliers: a line item opens a window for two files, touches one, or closes what is open."""
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    kind = F.when((o % 10 == 0) & (n == 1), "prompt").otherwise(_pick(KINDS[:-1], (o * 7 + n) % 9))
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "lineitem").select(
        s.alias("sid"), (o * 10 + n).alias("ord"), (o * 300 + n).alias("ts"), kind.alias("kind"), F.concat(F.lit("o"), text(p % 500)).alias("opportunity"), F.concat(F.lit("t"), text(o % 900)).alias("task"),
        F.when(p % 2 == 0, "armed").otherwise("holdback").alias("arm"), F.when(p % 3 > 0, "randomized").alias("mode"), F.lit("prompt").alias("surface"), F.array(F.concat(F.lit("f"), text(p % 20)), F.concat(F.lit("f"), text(s % 20))).alias("paths"), F.concat(F.lit("f"), text(p % 20)).alias("path"),
    )


@query()
def exposure_lifecycle(spark, sf_dir):
    """What opens, is deduped and closes, with each window's outcome; no SQL keeps sixteen windows in state."""
    return exposures.exposure_log(_rows(spark, sf_dir))


SNAPSHOTS_SQL = """SELECT l_suppkey % 5 AS repo, l_orderkey * 10 + l_linenumber AS ord, l_orderkey * 60000 AS ts, 'a' || (l_partkey % 300) AS agent, l_linenumber::BIGINT AS generation,
 CASE l_partkey % 7 WHEN 0 THEN 'identity_ambiguous' WHEN 1 THEN 'spawn_withheld' WHEN 2 THEN NULL ELSE 'written' END AS state FROM lineitem"""


def _snapshots(spark, sf_dir):
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    state = F.when(p % 7 == 0, "identity_ambiguous").when(p % 7 == 1, "spawn_withheld").when(p % 7 > 2, "written")
    return table(spark, sf_dir, "lineitem").select((s % 5).alias("repo"), (o * 10 + n).alias("ord"), (o * 60000).alias("ts"), F.concat(F.lit("a"), (p % 300).cast("string")).alias("agent"), n.cast("long").alias("generation"), state.alias("state"))


@query()
def snapshot_lifetimes(spark, sf_dir):
    """When and why each snapshot ends, with a cap of 200 for a repository; evictions depend on those before."""
    return lifetimes.lifetime_log(_snapshots(spark, sf_dir).drop("state"), stored=200)


#: A day before the last order's snapshot: later ones are of the future and stay.
NOW = "(SELECT max(ts) FROM s) - 43200000"


@query(f"""WITH s AS ({SNAPSHOTS_SQL}), own AS (SELECT *, row_number() OVER (PARTITION BY repo, agent ORDER BY ts DESC, generation DESC, state DESC NULLS LAST) AS own FROM s WHERE ts > {NOW} OR {NOW} - ts <= 86400000)
SELECT repo, agent, ts, generation, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, agent) AS place FROM own WHERE own = 1 AND (state IS NULL OR state NOT IN ('identity_ambiguous', 'spawn_withheld'))) WHERE place <= 64""")
def listed_snapshots(spark, sf_dir):
    """Each repository's newest 64 agents with a live snapshot, half a day before the log's end."""
    rows = _snapshots(spark, sf_dir)
    now = rows.agg(F.max("ts")).first()[0]
    return lifetimes.listed(rows, (now or 0) - 43_200_000)


#: Findings of suppliers' tasks, spelled in two ways; every eleventh order's isn't JSON.
FINDINGS_SQL = """SELECT l_suppkey AS task, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_orderkey % 11 = 0 THEN '{not json' WHEN l_linenumber % 2 = 1 THEN '{"path": "f' || (l_partkey % 5) || '", "lines": [' || (l_partkey % 3) || '.0, {"b":1e0, "a":' || (l_linenumber % 2) || '}], "kind":"changed"}'
 ELSE '{"kind":"changed","lines":[' || (l_partkey % 3) || ',{"a":' || (l_linenumber % 2) || ',"b":1}],"path":"f' || (l_partkey % 5) || '"}' END AS finding, '{"kind":"changed","lines":[' || (l_partkey % 3) || ',{"a":' || (l_linenumber % 2) || ',"b":1}],"path":"f' || (l_partkey % 5) || '"}' AS canonical FROM lineitem"""


@query(f"""WITH f AS ({FINDINGS_SQL}) SELECT task, (row_number() OVER (PARTITION BY task ORDER BY canonical))::INTEGER AS place, canonical, min(ord) AS ord, arg_min(finding, ord) AS finding, count(*) AS copies FROM f WHERE finding <> '{{not json' GROUP BY task, canonical""")
def unique_findings(spark, sf_dir):
    """Findings of a task that say the same, whatever the order of their keys and the spelling of their numbers, once each."""
    o, n, p = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    text = lambda *parts: F.concat(*(x.cast("string") if isinstance(x, F.Column) else F.lit(x) for x in parts))
    spaced = text('{"path": "f', p % 5, '", "lines": [', p % 3, '.0, {"b":1e0, "a":', n % 2, '}], "kind":"changed"}')
    tight = text('{"kind":"changed","lines":[', p % 3, ',{"a":', n % 2, ',"b":1}],"path":"f', p % 5, '"}')
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), (o * 10 + n).alias("ord"), F.when(o % 11 == 0, "{not json").when(n % 2 == 1, spaced).otherwise(tight).alias("finding"))
    return canonical.unique_sorted(rows, "task", "ord", "finding")


#: Worksets of agents: files and regions that they were shown, and the states of their claims.
WORKSETS_SQL = "SELECT DISTINCT l_suppkey % 5 AS task, 'a' || (l_partkey % 300) AS agent, CASE WHEN l_linenumber % 3 = 0 THEN 'region' ELSE 'path' END AS kind, CASE WHEN l_linenumber % 3 = 0 THEN 'f' || (l_orderkey % 900) || '#r' || (l_orderkey % 3) ELSE 'f' || (l_orderkey % 400) END AS item FROM lineitem"
CLAIMS_SQL = "SELECT l_suppkey % 5 AS task, 'a' || (l_partkey % 300) AS agent, ['unchanged', 'changed', 'invalidated', 'unknown', 'odd'][l_orderkey % 5 + 1] AS status FROM lineitem"
LISTED = f"listed AS (SELECT repo AS task, agent, place FROM ({ORACLE_SQL['listed_snapshots']}))"


def _worksets(spark, sf_dir):
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    text = lambda c: c.cast("string")
    region = n % 3 == 0
    item = F.when(region, F.concat(F.lit("f"), text(o % 900), F.lit("#r"), text(o % 3))).otherwise(F.concat(F.lit("f"), text(o % 400)))
    return table(spark, sf_dir, "lineitem").select(
        (s % 5).alias("task"), F.concat(F.lit("a"), text(p % 300)).alias("agent"), F.when(region, "region").otherwise("path").alias("kind"), item.alias("item"), _pick([*coherence.STATES, "odd"], o % 5).alias("status")
    )


def _listed(spark, sf_dir):
    return listed_snapshots(spark, sf_dir).withColumnRenamed("repo", "task")


@query(f"""WITH {LISTED}, w AS (SELECT w.* FROM ({WORKSETS_SQL}) w SEMI JOIN listed USING (task, agent)), m AS (SELECT x.task, x.agent AS a, y.agent AS b, x.kind, x.item FROM w x JOIN w y ON x.task = y.task AND x.kind = y.kind AND x.item = y.item AND x.agent < y.agent),
t AS (SELECT task, a, b, count(*) FILTER (kind = 'path') AS path_total, count(*) FILTER (kind = 'region') AS region_total, coalesce(list_sort(list(item) FILTER (kind = 'path'))[1:50], []) AS shared_paths, coalesce(list_sort(list(item) FILTER (kind = 'region'))[1:50], []) AS shared_regions FROM m GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY a, b)::INTEGER AS place, count(*) OVER (PARTITION BY task) AS pairs FROM t)
SELECT p.task, a, b, path_total, region_total, shared_paths, shared_regions, p.place, pairs, l.agent IN (a, b) AS involves_current FROM p JOIN listed l ON l.task = p.task AND l.place = 1 WHERE p.place <= 64""")
def coherence_overlaps(spark, sf_dir):
    """Pairs of a repository's listed agents that were shown the same files or regions; the newest agent is the current one."""
    listed = _listed(spark, sf_dir)
    return coherence.overlaps(listed, _worksets(spark, sf_dir), current=listed.filter("place = 1"))


@query(f"""WITH {LISTED}, c AS (SELECT c.* FROM ({CLAIMS_SQL}) c SEMI JOIN listed USING (task, agent)), n AS (SELECT task, count(*) AS agents FROM listed GROUP BY 1),
s AS (SELECT task, {', '.join(f"count(*) FILTER (status = '{x}') AS {x}" for x in coherence.STATES)} FROM c GROUP BY 1) SELECT task, agents, {', '.join(f'coalesce({x}, 0) AS {x}' for x in coherence.STATES)} FROM n LEFT JOIN s USING (task)""")
def coherence_totals(spark, sf_dir):
    """What has become of the claims of a repository's listed agents."""
    return coherence.totals(_listed(spark, sf_dir), _worksets(spark, sf_dir))
