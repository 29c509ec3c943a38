"""Queries over the telemetry log: its summary's parts, lifecycle joins, folds and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import statistics as st
from tidemark.operators import metrics as mt
from tidemark.plans.event_queries import _wilson_sql
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import LOG_SQL

LOG = f"log AS ({LOG_SQL})"


def _n(name: str, also: str = "true") -> str:
    return f"count(*) FILTER (name = '{name}' AND {also})"


def _s(name: str, column: str) -> str:
    return f"coalesce(sum({column}) FILTER (name = '{name}'), 0)::BIGINT"


def _rate(part: str, whole: str) -> str:
    return f"round({part} / nullif({whole}, 0), 6)"


FRESH, STALE, WANTED = _n("freshness.fresh_hit"), _n("freshness.stale_hit"), _n("retrieval.classified", "retrieve")


@query(f"""WITH {LOG} SELECT {FRESH} AS fresh, {STALE} AS stale, {_n('freshness.blackout_turn')} AS blackout, {_rate(STALE, f'({FRESH} + {STALE})')} AS stale_rate, {_rate(_n('freshness.blackout_turn'), f'({FRESH} + {STALE})')} AS blackout_rate,
{_n('freshness.sync_rescan')} AS sync_attempts, {_n('freshness.stale_hit', "reason = 'sync'")} AS sync_rescues FROM log""")
def freshness_metrics(spark, sf_dir):
    return mt.freshness(analogs.log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT {_n('retrieval.classified')} AS classified, {WANTED} AS retrieve, {_rate(WANTED, _n('retrieval.classified'))} AS fire_rate, {_n('retrieval.injected')} AS injected, {_n('retrieval.empty_fallback')} AS empty, {_n('retrieval.deduped')} AS deduped,
{_rate(_n('retrieval.empty_fallback'), WANTED)} AS empty_rate, {_n('retrieval.stale_hit')} AS stale, {_rate(_n('retrieval.stale_hit'), WANTED)} AS stale_rate FROM log""")
def retrieval_funnel(spark, sf_dir):
    return mt.funnel(analogs.log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT {_s('claim.served', 'n')} AS claims, {_n('contextdelta.emitted')} AS deltas, {_s('contextdelta.emitted', 'changed')} AS changed, {_n('structure.delta')} AS structural, {_n('sprawl.nudge')} AS nudges, {_n('coherence.agent_registered')} AS registered,
{_n('coherence.agent_returned')} AS returned, {_n('coherence.report_eligible')} AS eligible, {_n('coherence.delta_delivered')} AS delivered, {_s('coherence.delta_delivered', 'n')} AS overlaps, {_n('coherence.skipped')} AS skipped, {_n('blastradius.injected')} AS blasts,
{_s('blastradius.injected', 'n')} AS dependents, {_rate(_n('blastradius.path_hit'), '(' + _n('blastradius.path_hit') + ' + ' + _n('blastradius.path_miss') + ')')} AS blast_precision FROM log""")
def ledger_counters(spark, sf_dir):
    """Claims, structural deltas, coherence and blast radius in one pass over the log."""
    return mt.counters(analogs.log(spark, sf_dir))


@query(f"WITH {LOG} SELECT source, count(*) AS n FROM log WHERE name = 'retrieval.injected' GROUP BY 1")
def injected_by_source(spark, sf_dir):
    return mt.counted_by(analogs.log(spark, sf_dir).filter(mt.named("retrieval.injected")), F.col("source"), "source")


@query(f"WITH {LOG} SELECT coalesce(nullif(agent::VARCHAR, ''), '(unknown)') AS agent, count(*) AS n FROM log GROUP BY 1")
def count_by_agent(spark, sf_dir):
    return mt.counted_by(analogs.log(spark, sf_dir), F.col("agent"), "agent")


@query(f"""WITH {LOG} SELECT reason AS trigger, count(*) AS scans, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(duration_ms), 4) AS mean, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95,
round(quantile_cont(duration_ms, 0.99), 4) AS p99, max(duration_ms) AS most FROM log WHERE name = 'scan.completed' GROUP BY 1""")
def scan_metrics(spark, sf_dir):
    return mt.scans(analogs.log(spark, sf_dir))


def _arms_sql(lane: str) -> str:
    of = lambda a: f"max(hits) FILTER (arm = '{a}') AS {a}_hits, max(misses) FILTER (arm = '{a}') AS {a}_misses, max(turns) FILTER (arm = '{a}') AS {a}_turns"
    full = lambda a: f"{a}_hits + {a}_misses >= 30 AND {a}_turns >= 30"
    return f"""WITH {LOG}, s AS (SELECT coalesce(arm, 'armed') AS arm, name = 'retrieval.{lane}_hit' AS hit, turn FROM log WHERE name IN ('retrieval.{lane}_hit', 'retrieval.{lane}_miss')),
a AS (SELECT arm, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT turn) AS turns FROM s GROUP BY 1), b AS (SELECT {of('armed')}, {of('holdback')} FROM a)
SELECT *, round(armed_hits / (armed_hits + armed_misses) - holdback_hits / (holdback_hits + holdback_misses), 4) AS delta, CASE WHEN armed_turns IS NULL OR holdback_turns IS NULL THEN 'NO_ARM' WHEN {full('armed')} AND {full('holdback')} THEN 'AT_VOLUME' ELSE 'DORMANT' END AS gate FROM b"""


@query(_arms_sql("path"))
def open_benefit_delta(spark, sf_dir):
    return mt.precision_by_arm(analogs.log(spark, sf_dir), "path")


@query(_arms_sql("region"))
def region_benefit_delta(spark, sf_dir):
    return mt.precision_by_arm(analogs.log(spark, sf_dir), "region")


def _tools_sql(key: str, name: str) -> str:
    call = "tool <> '(tools/list)'"
    return f"WITH {LOG} SELECT coalesce({key}, '(unattributed)') AS {name}, count(*) FILTER ({call}) AS calls, count(*) FILTER (NOT {call}) AS lists, count(*) FILTER ({call} AND ok) AS ok, count(*) FILTER ({call} AND NOT ok) AS errors, {_rate(f'count(*) FILTER ({call})', f'count(*) FILTER (NOT {call})')} AS calls_per_list FROM log WHERE name = 'mcp.invoked' GROUP BY 1"


@query(_tools_sql("client", "client"))
def calls_by_client(spark, sf_dir):
    return mt.tools(analogs.log(spark, sf_dir), F.col("client"), "client")


@query(_tools_sql("tool", "tool"))
def calls_by_tool(spark, sf_dir):
    return mt.tools(analogs.log(spark, sf_dir), F.col("tool"), "tool")


@query("SELECT s_suppkey * 2 AS sid, coalesce(n, 0) AS events FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_suppkey = s_suppkey * 2")
def root_contributions(spark, sf_dir):
    roots = analogs.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("sid"))
    return mt.contributions(roots, analogs.log(spark, sf_dir), "sid")


@query(f"""WITH {LOG}, c AS (SELECT count(*) FILTER (coalesce(arm, 'armed') = 'armed' AND success)::DOUBLE AS k1, count(*) FILTER (coalesce(arm, 'armed') = 'armed')::DOUBLE AS n1, count(*) FILTER (arm = 'holdback' AND success)::DOUBLE AS k2, count(*) FILTER (arm = 'holdback')::DOUBLE AS n2 FROM log WHERE name = 'scan.completed')
SELECT round({_wilson_sql('k2', 'n2', '-')} - {_wilson_sql('k1', 'n1', '+')}, 6) AS low, round({_wilson_sql('k2', 'n2', '+')} - {_wilson_sql('k1', 'n1', '-')}, 6) AS high FROM c""")
def interval_difference(spark, sf_dir):
    """Holdback less armed, from the ends of both intervals."""
    arm = F.coalesce("arm", F.lit("armed"))
    n = lambda a, also=F.lit(True): F.count_if((arm == a) & also)
    c = analogs.log(spark, sf_dir).filter(mt.named("scan.completed")).agg(n("armed", F.col("success")).alias("k1"), n("armed").alias("n1"), n("holdback", F.col("success")).alias("k2"), n("holdback").alias("n2"))
    low, high = mt.interval_gap(*st.wilson(F.col("k1"), F.col("n1")), *st.wilson(F.col("k2"), F.col("n2")))
    return c.select(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH {LOG} SELECT r.ord, r.sid, r.agent, EXISTS (SELECT 1 FROM log s WHERE s.name = 'coherence.agent_registered' AND s.sid = r.sid AND s.agent = r.agent) AS spawned FROM log r WHERE r.name = 'coherence.agent_returned' AND r.agent IS NOT NULL")
def lifecycle_orphans(spark, sf_dir):
    log = analogs.log(spark, sf_dir)
    return mt.orphans(log.filter(mt.named("coherence.agent_returned")), log.filter(mt.named("coherence.agent_registered")))


@query(f"""WITH {LOG}, u AS (SELECT *, CASE WHEN agent IS NULL THEN ord END AS alone, CASE WHEN outcome IN ('ambiguous', 'withheld', 'moved') THEN 2 WHEN outcome IN ('written', 'retry') THEN 1 ELSE 0 END AS kind FROM log WHERE name = 'coherence.agent_registered'),
g AS (SELECT sid, agent, alone, (list(outcome ORDER BY kind DESC, ord DESC))[1] AS last, max(kind) AS kind, bool_or(outcome = 'written') AS ever, count(*) AS rows FROM u GROUP BY 1, 2, 3)
SELECT sid, agent, CASE WHEN kind = 1 THEN CASE WHEN ever THEN 'written' ELSE 'retry' END ELSE last END AS outcome, rows FROM g""")
def attempt_units(spark, sf_dir):
    return mt.attempt_units(analogs.log(spark, sf_dir).filter(mt.named("coherence.agent_registered")))


#: Spawns and returns; what becomes of agents 0 to 3 is always written at the first two sids, so that some sids are clean.
SPAWNS_SQL = "SELECT sid, agent, ord, ord AS ts, CASE WHEN name = 'coherence.agent_registered' THEN 'spawn' ELSE 'return' END AS stage, CASE WHEN sid <= 2 THEN CASE WHEN agent < 4 OR name = 'coherence.agent_returned' THEN 'written' ELSE 'retry' END ELSE outcome END AS outcome, reason FROM log WHERE name IN ('coherence.agent_registered', 'coherence.agent_returned')"
DEFECTS = f"""WITH {LOG}, r AS ({SPAWNS_SQL}), k AS (SELECT *, CASE WHEN outcome IN ('ambiguous', 'withheld', 'moved') THEN 2 WHEN outcome IN ('written', 'retry') THEN 1 ELSE 0 END AS kind, CASE WHEN agent IS NULL THEN ord END AS alone FROM r),
g AS (SELECT sid, stage, agent, alone, (list(outcome ORDER BY kind DESC, ord DESC))[1] AS last, (list(reason ORDER BY kind DESC, ord DESC))[1] AS reason, (list(ts ORDER BY kind DESC, ord DESC))[1] AS ts, max(kind) AS kind, bool_or(outcome = 'written') AS ever FROM k GROUP BY 1, 2, 3, 4),
u AS (SELECT sid, stage, agent, reason, ts, CASE WHEN kind = 1 THEN CASE WHEN ever THEN 'written' ELSE 'retry' END ELSE last END AS outcome FROM g),
d AS (SELECT u.sid, u.stage, u.outcome, u.reason, u.stage = 'return' AND s.outcome IS NOT NULL AND s.outcome NOT IN ('written', 'retry') AS explained, u.ts FROM u LEFT JOIN u s ON s.stage = 'spawn' AND s.sid = u.sid AND s.agent = u.agent WHERE u.outcome NOT IN ('written', 'retry'))"""


def _spawns(spark, sf_dir):
    rows = analogs.log(spark, sf_dir).filter(mt.named("coherence.agent_registered") | mt.named("coherence.agent_returned"))
    spawn = mt.named("coherence.agent_registered")
    clean = F.when((F.col("agent") < 4) | ~spawn, "written").otherwise("retry")
    return rows.select("sid", "agent", "ord", F.col("ord").alias("ts"), F.when(spawn, "spawn").otherwise("return").alias("stage"), F.when(F.col("sid") <= 2, clean).otherwise(F.col("outcome")).alias("outcome"), "reason")


@query(f"{DEFECTS} SELECT sid, stage, outcome, reason, explained, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM d GROUP BY ALL")
def lifecycle_defects(spark, sf_dir):
    """Failures of spawns and returns, and whether a return's is explained by its spawn's."""
    return mt.lifecycle_defects(_spawns(spark, sf_dir))[0]


@query(f"{DEFECTS} SELECT sid, CASE WHEN sid IN (SELECT sid FROM d WHERE NOT explained) THEN 'DEFECT_OPEN' ELSE 'CLEAN' END AS verdict FROM (SELECT DISTINCT sid FROM u)")
def lifecycle_verdicts(spark, sf_dir):
    return mt.lifecycle_defects(_spawns(spark, sf_dir))[1]


REPORTS = """reports AS (SELECT l_orderkey // 2 AS incident, ['eligible', 'delivered', 'deduped', 'heldback'][(l_orderkey + l_linenumber) % 4 + 1] AS stage, (l_quantity % 5)::BIGINT AS "overlaps", (l_partkey % 3)::BIGINT AS changed, (l_suppkey % 2)::BIGINT AS invalidated FROM lineitem)"""


@query(f"""WITH {REPORTS}, r AS (SELECT incident, el_o + el_c + el_i AS eligible, least(el_o, de_o1) + least(el_c, de_c1) + least(el_i, de_i1) AS delivered, least(el_o, greatest(de_o1, dd_o)) + least(el_c, greatest(de_c1, dd_c)) + least(el_i, greatest(de_i1, dd_i)) + least(greatest(0, el_o - greatest(de_o1, dd_o)), he_o) AS resolved
FROM (SELECT incident, coalesce(max("overlaps") FILTER (stage = 'eligible'), 0) AS el_o, coalesce(max(changed) FILTER (stage = 'eligible'), 0) AS el_c, coalesce(max(invalidated) FILTER (stage = 'eligible'), 0) AS el_i,
coalesce(max("overlaps") FILTER (stage = 'delivered'), 0) AS de_o1, coalesce(max(changed) FILTER (stage = 'delivered'), 0) AS de_c1, coalesce(max(invalidated) FILTER (stage = 'delivered'), 0) AS de_i1,
coalesce(max("overlaps") FILTER (stage = 'deduped'), 0) AS dd_o, coalesce(max(changed) FILTER (stage = 'deduped'), 0) AS dd_c, coalesce(max(invalidated) FILTER (stage = 'deduped'), 0) AS dd_i, coalesce(max("overlaps") FILTER (stage = 'heldback'), 0) AS he_o FROM reports GROUP BY 1))
SELECT incident, eligible, delivered, resolved, resolved = eligible AS closed FROM r WHERE eligible > 0""")
def finding_coverage(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    stage = F.element_at(F.array(*map(F.lit, ("eligible", "delivered", "deduped", "heldback"))), ((o + n) % 4 + 1).cast("int"))
    reports = analogs.table(spark, sf_dir, "lineitem").select(F.floor(o / 2).alias("incident"), stage.alias("stage"), (F.col("l_quantity") % 5).cast("long").alias("overlaps"), (F.col("l_partkey") % 3).alias("changed"), (F.col("l_suppkey") % 2).alias("invalidated"))
    return mt.finding_coverage(reports)


@query(f"WITH {LOG} SELECT sid, name, ord FROM (SELECT *, row_number() OVER (PARTITION BY sid, name ORDER BY ord) AS rn FROM log) WHERE rn = 1")
def first_row_per_key(spark, sf_dir):
    return analogs.log(spark, sf_dir).groupBy("sid", "name").agg(F.min("ord").alias("ord"))


@query(f"WITH {LOG} SELECT ord, name, sid FROM log ORDER BY ord DESC LIMIT 20")
def event_tail(spark, sf_dir):
    return analogs.log(spark, sf_dir).select("ord", "name", "sid").orderBy(F.desc("ord")).limit(20)


@query(f"""WITH {LOG}, c AS (SELECT sid, count(*) AS seen, (max(ord) - min(ord)) / 1000.0 AS days FROM log WHERE name = 'mcp.invoked' GROUP BY 1), e AS (SELECT *, CASE WHEN days > 0 THEN (100 - seen) / (seen / days) END AS eta FROM c)
SELECT sid, round(eta, 4) AS eta_days, coalesce(eta <= 180, false) AS reachable FROM e""")
def gap_eta(spark, sf_dir):
    rows = analogs.log(spark, sf_dir).filter(mt.named("mcp.invoked")).groupBy("sid").agg(F.count("*").alias("seen"), ((F.max("ord") - F.min("ord")) / 1000.0).alias("days"))
    eta, reachable = mt.days_to_go(F.col("seen"), F.lit(100), F.col("days"))
    return rows.select("sid", F.round(eta, 4).alias("eta_days"), reachable.alias("reachable"))


@query("""WITH h AS (SELECT l_partkey AS path, l_orderkey AS idx, CASE WHEN min(l_linenumber) % 2 = 1 THEN 'A' ELSE 'D' END AS type FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, lag(type) OVER w AS before, lag(idx) OVER w AS since FROM h WINDOW w AS (PARTITION BY path ORDER BY idx))
SELECT count(*) FILTER (type = 'A') AS added, count(*) FILTER (type = 'D' AND before = 'A' AND idx - since <= 400) AS abandoned, round(count(*) FILTER (type = 'D' AND before = 'A' AND idx - since <= 400) / nullif(count(*) FILTER (type = 'A'), 0), 3) AS rate FROM s""")
def abandonment_rate(spark, sf_dir):
    kind = F.when(F.min("l_linenumber") % 2 == 1, "A").otherwise("D")
    history = analogs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("idx")).agg(kind.alias("type"))
    return mt.abandoned(history, 400)


@query("""WITH RECURSIVE c AS (SELECT l_suppkey AS path, l_partkey % 20 AS item, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS step, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem),
f(path, item, n, net) AS (SELECT path, item, n, step FROM c WHERE n = 1 UNION ALL SELECT c.path, c.item, c.n, least(1, greatest(-1, f.net + c.step)) FROM f JOIN c ON c.path = f.path AND c.item = f.item AND c.n = f.n + 1),
l AS (SELECT path, item, (list(net ORDER BY n DESC))[1] AS net FROM f GROUP BY 1, 2)
SELECT path, coalesce(list_sort(list(item) FILTER (net > 0)), []) AS added, coalesce(list_sort(list(item) FILTER (net < 0)), []) AS removed FROM l WHERE net <> 0 GROUP BY 1""")
def net_structural_fold(spark, sf_dir):
    lines = analogs.table(spark, sf_dir, "lineitem")
    step = F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1)
    return mt.net_changes(lines.select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 20).alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), step.alias("step")))


CASES = """old AS (SELECT o_custkey AS "case", o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_custkey % 11 <> 0),
new AS (SELECT o_custkey AS "case", o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice * (1 + o_orderkey % 3) DESC, o_orderkey) AS rank FROM orders WHERE o_custkey % 13 <> 0)"""


@query(f"""WITH {CASES}, w AS (SELECT "case", list_sort(list(path)) AS was FROM old WHERE rank <= 3 GROUP BY 1), n AS (SELECT "case", list_sort(list(path)) AS now FROM new WHERE rank <= 3 GROUP BY 1),
b AS (SELECT coalesce(w."case", n."case") AS "case", was, now, list_filter(coalesce(was, []), lambda x: NOT list_contains(coalesce(now, []), x)) AS lost FROM w FULL JOIN n ON w."case" = n."case")
SELECT "case", CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN len(lost) > 0 THEN 'dropped' ELSE 'kept' END AS state, CASE WHEN was IS NOT NULL AND now IS NOT NULL THEN lost ELSE [] END AS dropped FROM b""")
def top3_retention(spark, sf_dir):
    orders = analogs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("path"), "o_totalprice")
    ranked = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc(by), "path")))
    old = ranked(orders.filter("case % 11 <> 0").withColumn("by", F.col("o_totalprice")), "by")
    new = ranked(orders.filter("case % 13 <> 0").withColumn("by", F.col("o_totalprice") * (1 + F.col("path") % 3)), "by")
    return mt.dropped_from_top(old, new, 3)


@query(f"WITH {CASES}, r AS (SELECT \"case\", count(*) AS relevant, count(*) FILTER (path IN (SELECT path FROM new WHERE rank <= 5)) AS found FROM old WHERE rank <= 5 GROUP BY 1) SELECT \"case\", round(found / relevant, 6) AS recall FROM r")
def recall_of_runs(spark, sf_dir):
    orders = analogs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("path"), "o_totalprice")
    first = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(by.desc(), "path"))).filter("rank <= 5").select("case", "path")
    relevant, found = first(orders.filter("case % 11 <> 0"), F.col("o_totalprice")), first(orders.filter("case % 13 <> 0"), F.col("o_totalprice") * (1 + F.col("path") % 3))
    return st.recall(relevant, found, "case", "path")


@query(f"""WITH {LOG}, r AS (SELECT source, count(*) FILTER (name = 'retrieval.path_hit')::DOUBLE AS k, count(*)::DOUBLE AS n FROM log WHERE name IN ('retrieval.path_hit', 'retrieval.path_miss') GROUP BY 1)
SELECT source, n::BIGINT AS surfaced, round(k / n, 6) AS rate, round({_wilson_sql('k', 'n', '-')}, 6) AS low, round({_wilson_sql('k', 'n', '+')}, 6) AS high FROM r""")
def tune_report(spark, sf_dir):
    scored = analogs.log(spark, sf_dir).filter(mt.named("retrieval.path_hit") | mt.named("retrieval.path_miss"))
    rows = scored.groupBy("source").agg(F.count_if(mt.named("retrieval.path_hit")).alias("k"), F.count("*").alias("surfaced"))
    low, high = st.wilson(F.col("k"), F.col("surfaced"))
    return rows.select("source", "surfaced", F.round(F.col("k") / F.col("surfaced"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


TOUCHES = "touches AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_suppkey AS sid, l_partkey % 200 AS path, l_returnflag = 'R' AS mutates, l_returnflag = 'N' AS reads FROM lineitem)"


@query(f"""WITH {TOUCHES} SELECT t.ord, t.sid, t.path FROM touches t LEFT JOIN (SELECT sid, path, min(ord) AS first_read FROM touches WHERE reads GROUP BY 1, 2) r ON r.sid = t.sid AND r.path = t.path WHERE t.mutates AND (first_read IS NULL OR first_read >= t.ord)""")
def blind_mutations(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    touches = analogs.table(spark, sf_dir, "lineitem").select((o * 10 + n).alias("ord"), F.col("l_suppkey").alias("sid"), (F.col("l_partkey") % 200).alias("path"), "l_returnflag")
    return mt.blind_mutations(touches, F.col("l_returnflag") == "R", F.col("l_returnflag") == "N")


@query("""WITH opens AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_orderkey AS ts, l_suppkey AS sid, l_partkey % 30 AS path FROM lineitem WHERE l_linenumber > 1),
sets AS (SELECT l_suppkey AS sid, l_orderkey AS ts, list(DISTINCT l_partkey % 30) AS paths FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT o.ord, o.sid, o.path, coalesce(o.ts - s.ts <= 300 AND list_contains(s.paths, o.path), false) AS hit FROM opens o ASOF LEFT JOIN sets s ON o.sid = s.sid AND o.ts >= s.ts""")
def open_attribution(spark, sf_dir):
    lines = analogs.table(spark, sf_dir, "lineitem")
    opens = lines.filter("l_linenumber > 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_orderkey").alias("ts"), F.col("l_suppkey").alias("sid"), (F.col("l_partkey") % 30).alias("path"))
    sets = lines.filter("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("sid"), F.col("l_orderkey").alias("ts")).agg(F.collect_set(F.col("l_partkey") % 30).alias("paths"))
    return mt.attributed(opens, sets, 300)


@query("""WITH notes AS (SELECT l_orderkey AS id, l_partkey AS file FROM lineitem), files AS (SELECT p_partkey AS id FROM part WHERE p_size <> 7) SELECT id, count(*) AS missing FROM (SELECT DISTINCT id, file FROM notes) WHERE file NOT IN (SELECT id FROM files) GROUP BY 1""")
def stale_notes(spark, sf_dir):
    notes = analogs.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("files"))
    files = analogs.table(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("id"))
    return mt.stale_notes(notes, files)


@query("""WITH a AS (SELECT l_partkey AS path, l_suppkey AS h FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_partkey AS path, l_suppkey AS h FROM lineitem WHERE l_linenumber >= 3)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS lost, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS gained""")
def corpus_equality(spark, sf_dir):
    """Two snapshots are equal if nothing is lost and nothing gained; repeated rows count."""
    rows = lambda cut: analogs.table(spark, sf_dir, "lineitem").filter(cut).select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("h"))
    a, b = rows("l_linenumber <= 3"), rows("l_linenumber >= 3")
    return a.exceptAll(b).agg(F.count("*").alias("lost")).join(b.exceptAll(a).agg(F.count("*").alias("gained")))  # one row each


@query("""WITH u AS (SELECT l_partkey AS path, 1 AS phase, l_orderkey AS ord FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 2, l_orderkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT path, phase, ord FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY phase, ord) AS rn FROM u) WHERE rn = 1""")
def union_first_wins(spark, sf_dir):
    lines = analogs.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("phase"), F.col("l_orderkey").alias("ord"))
    return lines.groupBy("path").agg(F.min(F.struct("phase", "ord")).alias("first")).select("path", "first.*")


@query("""WITH w AS (SELECT o_custkey AS task, list_sort(list(DISTINCT l_suppkey % 20)) AS named, list_sort(list(DISTINCT l_partkey % 20)) AS touched FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT task, list_filter(named, lambda x: list_contains(touched, x)) AS seen, list_filter(named, lambda x: NOT list_contains(touched, x)) AS unseen FROM w""")
def witnesses_observed(spark, sf_dir):
    lines = analogs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("task")).join(analogs.table(spark, sf_dir, "lineitem"), "l_orderkey")
    sets = lines.groupBy("task").agg(F.collect_set(F.col("l_suppkey") % 20).alias("named"), F.collect_set(F.col("l_partkey") % 20).alias("touched"))
    return sets.select("task", F.array_sort(F.array_intersect("named", "touched")).alias("seen"), F.array_sort(F.array_except("named", "touched")).alias("unseen"))


@query("""WITH s AS (SELECT l_suppkey AS path, max(l_partkey) FILTER (l_linenumber <= 2) AS was, max(l_partkey) FILTER (l_linenumber > 2) AS now FROM lineitem GROUP BY 1) SELECT path, was, now FROM s WHERE was IS DISTINCT FROM now AND path % 3 <> 0""")
def status_drift(spark, sf_dir):
    """Paths whose state differs from the stored one and that the session itself hasn't touched; none means the session caused all drift."""
    lines = analogs.table(spark, sf_dir, "lineitem")
    at = lambda cut, name: lines.filter(cut).groupBy(F.col("l_suppkey").alias("path")).agg(F.max("l_partkey").alias(name))
    touched = lines.filter("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("path")).distinct()
    both = at("l_linenumber <= 2", "was").join(at("l_linenumber > 2", "now"), "path", "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).join(touched, "path", "left_anti")
