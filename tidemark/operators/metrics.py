"""Metrics of the telemetry log, each in one pass of conditional aggregates, and what joins its events to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns and scored opens that an arm needs before its rate is told.
ARM_FLOOR, HORIZON_DAYS = 30, 180
TERMINAL, SUCCESS = ["ambiguous", "withheld", "moved"], ["written", "retry"]
FINDINGS = ["overlaps", "changed", "invalidated"]


def named(name: str) -> Column:
    return F.col("name") == name


def count(name: str, also: Column | None = None) -> Column:
    return F.count_if(named(name) if also is None else named(name) & also)


def total(name: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(named(name), F.col(column))), F.lit(0))


def rate(part: Column, whole: Column) -> Column:
    """Six places; null without a whole."""
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def freshness(log: DataFrame) -> DataFrame:
    fresh, stale, black = (count(f"freshness.{x}") for x in ("fresh_hit", "stale_hit", "blackout_turn"))
    return log.agg(
        fresh.alias("fresh"), stale.alias("stale"), black.alias("blackout"), rate(stale, fresh + stale).alias("stale_rate"), rate(black, fresh + stale).alias("blackout_rate"),
        count("freshness.sync_rescan").alias("sync_attempts"), count("freshness.stale_hit", F.col("reason") == "sync").alias("sync_rescues"),
    )


def funnel(log: DataFrame) -> DataFrame:
    asked, wanted = count("retrieval.classified"), count("retrieval.classified", F.col("retrieve"))
    empty, stale = count("retrieval.empty_fallback"), count("retrieval.stale_hit")
    return log.agg(
        asked.alias("classified"), wanted.alias("retrieve"), rate(wanted, asked).alias("fire_rate"), count("retrieval.injected").alias("injected"), empty.alias("empty"), count("retrieval.deduped").alias("deduped"),
        rate(empty, wanted).alias("empty_rate"), stale.alias("stale"), rate(stale, wanted).alias("stale_rate"),
    )


def counters(log: DataFrame) -> DataFrame:
    """Claims, structure, coherence and blast radius, all in one pass."""
    hit, miss = count("blastradius.path_hit"), count("blastradius.path_miss")
    return log.agg(
        total("claim.served", "n").alias("claims"), count("contextdelta.emitted").alias("deltas"), total("contextdelta.emitted", "changed").cast("long").alias("changed"), count("structure.delta").alias("structural"), count("sprawl.nudge").alias("nudges"),
        count("coherence.agent_registered").alias("registered"), count("coherence.agent_returned").alias("returned"), count("coherence.report_eligible").alias("eligible"), count("coherence.delta_delivered").alias("delivered"),
        total("coherence.delta_delivered", "n").alias("overlaps"), count("coherence.skipped").alias("skipped"), count("blastradius.injected").alias("blasts"), total("blastradius.injected", "n").alias("dependents"), rate(hit, hit + miss).alias("blast_precision"),
    )


def counted_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit("(unknown)")).alias(name)).agg(F.count("*").alias("n"))


def scans(log: DataFrame) -> DataFrame:
    p = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    done = log.filter(named("scan.completed") & F.col("duration_ms").isNotNull())
    return done.groupBy(F.col("reason").alias("trigger")).agg(
        F.count("*").alias("scans"), rate(F.count_if("success"), F.count("*")).alias("success_rate"), F.round(F.avg("duration_ms"), 4).alias("mean"), F.round(p[0], 4).alias("p50"), F.round(p[1], 4).alias("p95"), F.round(p[2], 4).alias("p99"), F.max("duration_ms").alias("most")
    )


def precision_by_arm(log: DataFrame, lane: str) -> DataFrame:
    """Hits and misses of a lane by arm, rows of old logs being armed; the difference of the arms' precisions; and whether it may be told."""
    scored = log.filter(named(f"retrieval.{lane}_hit") | named(f"retrieval.{lane}_miss")).withColumn("arm", F.coalesce("arm", F.lit("armed")))
    hits = F.count_if(named(f"retrieval.{lane}_hit"))
    arms = scored.groupBy("arm").agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.countDistinct("turn").alias("turns"))
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    both = arms.agg(*(of(a, c).alias(f"{a}_{c}") for a in ("armed", "holdback") for c in ("hits", "misses", "turns")))
    part = lambda a: F.col(f"{a}_hits") / (F.col(f"{a}_hits") + F.col(f"{a}_misses"))
    full = [(F.col(f"{a}_hits") + F.col(f"{a}_misses") >= ARM_FLOOR) & (F.col(f"{a}_turns") >= ARM_FLOOR) for a in ("armed", "holdback")]
    told = F.when(F.col("holdback_turns").isNull() | F.col("armed_turns").isNull(), "NO_ARM").when(full[0] & full[1], "AT_VOLUME").otherwise("DORMANT")
    return both.select("*", F.round(part("armed") - part("holdback"), 4).alias("delta"), told.alias("gate"))


def tools(log: DataFrame, key: Column, name: str) -> DataFrame:
    """Calls against listings of the tools, by client or tool; a listing is no call."""
    calls, lists = F.count_if(F.col("tool") != "(tools/list)"), F.count_if(F.col("tool") == "(tools/list)")
    ok = lambda v: F.count_if((F.col("tool") != "(tools/list)") & (F.col("ok") == v))
    return log.filter(named("mcp.invoked")).groupBy(F.coalesce(key, F.lit("(unattributed)")).alias(name)).agg(
        calls.alias("calls"), lists.alias("lists"), ok(True).alias("ok"), ok(False).alias("errors"), rate(calls, lists).alias("calls_per_list")
    )


def contributions(roots: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Events of every root of a list, those without any at 0."""
    return roots.join(log.groupBy(key).agg(F.count("*").alias("events")), key, "left").select(key, F.coalesce("events", F.lit(0)).alias("events"))


def interval_gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> tuple[Column, Column]:
    """The widest difference of two intervals, second less first: wider than an interval of the difference."""
    return low_b - high_a, high_b - low_a


def orphans(returned: DataFrame, spawned: DataFrame) -> DataFrame:
    """Returns by (sid, agent) with whether the same agent was ever spawned; rows without an agent have no identity and stay out."""
    known = spawned.filter("agent is not null").select("sid", "agent").distinct().withColumn("spawned", F.lit(True))
    return returned.filter("agent is not null").join(known, ["sid", "agent"], "left").select("ord", "sid", "agent", F.coalesce("spawned", F.lit(False)).alias("spawned"))


def attempt_units(rows: DataFrame) -> DataFrame:
    """One row for each (sid, agent): its last terminal outcome, else its last success (written if it ever was), else its last; rows without an agent stay apart."""
    kind = F.when(F.col("outcome").isin(TERMINAL), 2).when(F.col("outcome").isin(SUCCESS), 1).otherwise(0)
    ever = F.max(F.col("outcome") == "written")
    unit = rows.groupBy("sid", "agent", F.when(F.col("agent").isNull(), F.col("ord")).alias("alone")).agg(
        F.max_by("outcome", F.struct(kind, "ord")).alias("last"), F.max(kind).alias("kind"), ever.alias("ever"), F.count("*").alias("rows")
    )
    outcome = F.when((F.col("kind") == 1) & F.col("ever"), "written").when(F.col("kind") == 1, "retry").otherwise(F.col("last"))
    return unit.select("sid", "agent", outcome.alias("outcome"), "rows")


def lifecycle_defects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What went wrong where agents were spawned or returned (sid, agent, stage spawn or return, outcome, reason, ord, ts), and a verdict for each sid.

    Attempts of one agent at one stage are a unit, see attempt_units. A failed return whose
    own spawn failed is explained by that; a sid with any defect that isn't is open.
    """
    kind = F.when(F.col("outcome").isin(TERMINAL), 2).when(F.col("outcome").isin(SUCCESS), 1).otherwise(0)
    unit = rows.groupBy("sid", "stage", "agent", F.when(F.col("agent").isNull(), F.col("ord")).alias("alone")).agg(
        F.max_by(F.struct("outcome", "reason", "ts"), F.struct(kind, "ord")).alias("last"), F.max(kind).alias("kind"), F.max(F.col("outcome") == "written").alias("ever")
    )
    outcome = F.when((F.col("kind") == 1) & F.col("ever"), "written").when(F.col("kind") == 1, "retry").otherwise(F.col("last.outcome"))
    units = unit.select("sid", "stage", "agent", outcome.alias("outcome"), "last.reason", "last.ts")
    spawned = units.filter("stage = 'spawn' and agent is not null").select("sid", "agent", F.col("outcome").alias("spawn_outcome"))
    bad = units.filter(~F.coalesce(F.col("outcome").isin(SUCCESS), F.lit(False))).join(spawned, ["sid", "agent"], "left")
    explained = (F.col("stage") == "return") & F.col("spawn_outcome").isNotNull() & ~F.col("spawn_outcome").isin(SUCCESS)
    defects = bad.withColumn("explained", explained).groupBy("sid", "stage", "outcome", "reason", "explained").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    open_sids = defects.filter(~F.col("explained")).select("sid").distinct().withColumn("open", F.lit(True))
    verdict = F.when(F.col("open"), "DEFECT_OPEN").otherwise("CLEAN")
    return defects, units.select("sid").distinct().join(open_sids, "sid", "left").select("sid", verdict.alias("verdict"))


def finding_coverage(reports: DataFrame) -> DataFrame:
    """Per incident the most findings of each kind that were eligible, delivered, told before and held back; what of the eligible was delivered and resolved."""
    of = lambda stage, c: F.coalesce(F.max(F.when(F.col("stage") == stage, F.col(c))), F.lit(0))
    held = reports.groupBy("incident").agg(*(of(s, c).alias(f"{s}_{c}") for s in ("eligible", "delivered", "deduped", "heldback") for c in FINDINGS))
    held = held.filter(" + ".join(f"eligible_{c}" for c in FINDINGS) + " > 0")
    add = lambda f: sum((f(c) for c in FINDINGS[1:]), f(FINDINGS[0]))
    shown = lambda c: F.greatest(f"delivered_{c}", f"deduped_{c}")
    eligible, delivered = add(lambda c: F.col(f"eligible_{c}")), add(lambda c: F.least(f"eligible_{c}", f"delivered_{c}"))
    covered = add(lambda c: F.least(F.col(f"eligible_{c}"), shown(c)))
    back = F.least(F.greatest(F.lit(0), F.col("eligible_overlaps") - shown("overlaps")), F.col("heldback_overlaps"))
    return held.select("incident", eligible.alias("eligible"), delivered.alias("delivered"), (covered + back).alias("resolved"), (covered + back == eligible).alias("closed"))


def days_to_go(observed: Column, target: Column, span_days: Column) -> tuple[Column, Column]:
    """Days until a count is reached at the rate so far, and whether that is within the horizon; null without any so far."""
    eta = F.when((span_days > 0) & (observed > 0), (target - observed) / (observed / span_days))
    return eta, F.coalesce(eta <= HORIZON_DAYS, F.lit(False))


def abandoned(history: DataFrame, within: int) -> DataFrame:
    """Files (path, idx, type A or D): how many additions are deleted again within so many commits of the latest addition."""
    w = Window.partitionBy("path").orderBy("idx")
    seen = history.withColumns({"before": F.lag("type").over(w), "since": F.lag("idx").over(w)})
    gone = (F.col("type") == "D") & (F.col("before") == "A") & (F.col("idx") - F.col("since") <= within)
    added, lost = F.count_if(F.col("type") == "A"), F.count_if(gone)
    return seen.agg(added.alias("added"), lost.alias("abandoned"), F.round(lost / F.nullif(added, F.lit(0)), 3).alias("rate"))


def net_changes(changes: DataFrame) -> DataFrame:
    """Changes (path, item, ord, step 1 or -1) folded in order: an undone change cancels, a repeated one counts once; what is left, by path."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ord", "step"))), lambda x: x["step"])
    fold = F.aggregate(steps, F.lit(0), lambda net, s: F.least(F.lit(1), F.greatest(F.lit(-1), net + s)))
    net = changes.groupBy("path", "item").agg(fold.alias("net")).filter("net <> 0")
    return net.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("net") > 0, F.col("item")))).alias("added"), F.array_sort(F.collect_list(F.when(F.col("net") < 0, F.col("item")))).alias("removed"))


def dropped_from_top(old: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """Cases (case, rank, path) of two runs: paths that left the first places, and cases that only one run has."""
    first = lambda df, name: df.filter(F.col("rank") <= top).groupBy("case").agg(F.array_sort(F.collect_set("path")).alias(name))
    both = first(old, "was").join(first(new, "now"), "case", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.size(F.array_except("was", "now")) > 0, "dropped").otherwise("kept")
    return both.select("case", state.alias("state"), F.when(state == "dropped", F.array_except("was", "now")).otherwise(F.array().cast("array<bigint>")).alias("dropped"))


def blind_mutations(touches: DataFrame, mutates: Column, reads: Column) -> DataFrame:
    """Mutations of (sid, path) that no read of the same session and path came before."""
    before = Window.partitionBy("sid", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(reads.cast("int")).over(before), F.lit(0))
    return touches.withColumn("seen", seen).filter(mutates & (F.col("seen") == 0)).select("ord", "sid", "path")


def attributed(opens: DataFrame, sets: DataFrame, ttl: int) -> DataFrame:
    """Opens (ord, ts, sid, path) that are in the latest set of paths (sid, ts, paths) their session was given, if that isn't too old."""
    both = opens.select("sid", "ts", F.lit(1).alias("side"), "ord", "path", F.lit(None).cast("struct<ts: bigint, paths: array<bigint>>").alias("given")).unionByName(
        sets.select("sid", "ts", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("path"), F.struct(F.col("ts").alias("ts"), "paths").alias("given"))
    )
    latest = F.last("given", ignorenulls=True).over(Window.partitionBy("sid").orderBy("ts", "side", "ord").rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("latest", latest).filter("side = 1")
    hit = F.coalesce((F.col("ts") - F.col("latest.ts") <= ttl) & F.array_contains("latest.paths", F.col("path")), F.lit(False))
    return seen.select("ord", "sid", "path", hit.alias("hit"))


def stale_notes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes (id, files) that name any file that is gone."""
    named_files = notes.select("id", F.explode("files").alias("file"))
    return named_files.join(files.select(F.col("id").alias("file")), "file", "left_anti").groupBy("id").agg(F.count("*").alias("missing"))
