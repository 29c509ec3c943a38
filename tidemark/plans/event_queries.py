"""Queries over the event log and its experiment arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import statistics as st
from tidemark.operators import events as ev
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.streaming import windows

EVENTS = f"e AS ({analogs.EVENTS_SQL})"
IS_OPEN, IS_HIT = "name IN ('click', 'view', 'purchase')", "name = 'purchase'"
IS_MISS, SCOPE = "name = 'view'", "name = 'signup'"
TURNS = f"""{EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY sid, turn ORDER BY ord) AS rank FROM e WHERE name IN ('click', 'view', 'purchase')),
t AS (SELECT sid, turn, (list(arm ORDER BY ord))[1] AS arm, count(*) AS opens, count(*) FILTER (name = 'purchase') AS hits, min(CASE WHEN name = 'purchase' THEN rank END)::INTEGER AS first_hit_rank FROM o GROUP BY 1, 2)"""


def _turns(spark, sf_dir):
    return ev.turn_rollup(analogs.events(spark, sf_dir), F.expr(IS_OPEN), F.expr(IS_HIT))


@query(f"WITH {EVENTS} SELECT name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1")
def event_counts(spark, sf_dir):
    return ev.counts_and_span(analogs.events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT name, count(*) AS n FROM e WHERE ts >= 1704672000000 AND ts < 1705276800000 GROUP BY 1")
def window_counts(spark, sf_dir):
    return ev.in_window(analogs.events(spark, sf_dir), 1704672000000, 1705276800000).groupBy("name").agg(F.count("*").alias("n"))


STATS = "count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS most"


@query(f"WITH {EVENTS} SELECT {STATS} FROM e")
def duration_stats(spark, sf_dir):
    return ev.duration_stats(analogs.events(spark, sf_dir), [])


@query(f"WITH {EVENTS} SELECT name, {STATS} FROM e GROUP BY 1")
def durations_by_trigger(spark, sf_dir):
    return ev.duration_stats(analogs.events(spark, sf_dir), ["name"])


@query(f"WITH {TURNS} SELECT sid, turn, arm, opens, hits, first_hit_rank FROM t")
def turn_rollup(spark, sf_dir):
    return _turns(spark, sf_dir)


@query(f"WITH {TURNS} SELECT arm, count(*) AS turns, count(*) FILTER (hits > 0) AS hit_turns, round(count(*) FILTER (hits > 0) / count(*), 6) AS rate FROM t GROUP BY 1")
def turn_hit_rate_by_arm(spark, sf_dir):
    return ev.arm_hit_rates(_turns(spark, sf_dir))


def _wilson_sql(k: str, n: str, sign: str) -> str:
    edge = f"(({k} / {n} + 1.96 * 1.96 / (2 * {n})) {sign} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})"
    return f"greatest({edge}, 0.0)" if sign == "-" else f"least({edge}, 1.0)"


@query(f"WITH {TURNS}, w AS (SELECT arm, count(*) FILTER (hits > 0)::DOUBLE AS k, count(*)::DOUBLE AS n FROM t GROUP BY 1) SELECT arm, round({_wilson_sql('k', 'n', '-')}, 6) AS low, round({_wilson_sql('k', 'n', '+')}, 6) AS high FROM w")
def wilson_interval(spark, sf_dir):
    rates = ev.arm_hit_rates(_turns(spark, sf_dir))
    low, high = st.wilson(F.col("hit_turns"), F.col("turns"))
    return rates.select("arm", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {TURNS}, c AS (SELECT count(*) FILTER (arm = 'armed' AND hits > 0)::DOUBLE AS k1, count(*) FILTER (arm = 'armed')::DOUBLE AS n1, count(*) FILTER (arm = 'holdback' AND hits > 0)::DOUBLE AS k2, count(*) FILTER (arm = 'holdback')::DOUBLE AS n2 FROM t),
i AS (SELECT *, {_wilson_sql('k1', 'n1', '-')} AS l1, {_wilson_sql('k1', 'n1', '+')} AS u1, {_wilson_sql('k2', 'n2', '-')} AS l2, {_wilson_sql('k2', 'n2', '+')} AS u2 FROM c),
d AS (SELECT *, k1 / n1 - k2 / n2 - sqrt((k1 / n1 - l1) * (k1 / n1 - l1) + (u2 - k2 / n2) * (u2 - k2 / n2)) AS low, k1 / n1 - k2 / n2 + sqrt((u1 - k1 / n1) * (u1 - k1 / n1) + (k2 / n2 - l2) * (k2 / n2 - l2)) AS high FROM i)
SELECT k1::BIGINT AS k1, n1::BIGINT AS n1, k2::BIGINT AS k2, n2::BIGINT AS n2, round(k1 / n1 - k2 / n2, 4) AS delta, round(low, 6) AS low, round(high, 6) AS high, low <= 0 AND high >= 0 AS spans_zero FROM d""")
def newcombe_diff(spark, sf_dir):
    return ev.arm_delta(_turns(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT arm, count(*) FILTER (name = 'purchase') AS hits, count(*) FILTER (name = 'view') AS misses, round(count(*) FILTER (name = 'purchase') / nullif(count(*) FILTER (name IN ('purchase', 'view')), 0), 4) AS precision FROM e GROUP BY 1")
def arm_precision_delta(spark, sf_dir):
    return ev.arm_precision(analogs.events(spark, sf_dir), F.expr(IS_HIT), F.expr(IS_MISS))


@query(f"WITH {TURNS} SELECT arm, count(*) AS turns, sum(opens)::BIGINT AS opens, CASE WHEN count(*) >= 30 AND sum(opens) >= 30 THEN 'AT_VOLUME' ELSE 'DORMANT' END AS gate FROM t GROUP BY 1")
def arm_gates(spark, sf_dir):
    turns = _turns(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("turns"), F.sum("opens").alias("opens"))
    return turns.withColumn("gate", ev.gate(F.col("turns"), F.col("opens"), F.lit(False), 30))


@query(f"WITH {EVENTS}, c AS (SELECT name, count(*) FILTER (arm = 'armed') AS a, count(*) FILTER (arm = 'holdback') AS h FROM e GROUP BY 1) SELECT round(0.5 * sum(abs(a / (SELECT sum(a) FROM c) - h / (SELECT sum(h) FROM c))), 6) AS distance FROM c")
def arm_tvd(spark, sf_dir):
    return ev.arm_distance(analogs.events(spark, sf_dir), "name")


@query(f"""WITH {EVENTS}, s AS (SELECT *, coalesce(max((name = 'signup')::INTEGER) OVER (PARTITION BY sid, turn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM e)
SELECT arm, count(*) FILTER (name = 'purchase') AS hits, count(*) FILTER (name = 'purchase' AND open = 1) AS scoped_hits FROM s GROUP BY 1""")
def scoped_hits_running(spark, sf_dir):
    return ev.hits_in_scope(analogs.events(spark, sf_dir), F.expr(SCOPE), F.expr(IS_HIT))


@query("SELECT 'k' AS source, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS surfaced, count(*) AS rows FROM events")
def map_explode_sum(spark, sf_dir):
    counts = F.from_json("props", "map<string, bigint>")
    exploded = analogs.table(spark, sf_dir, "events").select(F.explode(counts).alias("source", "n"))
    return exploded.groupBy("source").agg(F.sum("n").alias("surfaced"), F.count("*").alias("rows"))


@query(f"WITH {EVENTS} SELECT sid, count(DISTINCT turn % 2) AS arms FROM e WHERE name = 'error' GROUP BY 1 HAVING count(DISTINCT turn % 2) > 1")
def contaminated_sessions(spark, sf_dir):
    return ev.mixed_sessions(analogs.events(spark, sf_dir).filter("name = 'error'").withColumn("arm_by_turn", F.col("turn") % 2))


@query(f"""WITH {EVENTS}, r AS (SELECT *, CASE name WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS pri FROM e)
SELECT sid, turn, (list(name ORDER BY pri DESC, ord DESC))[1] AS name, (list(ord ORDER BY pri DESC, ord DESC))[1] AS ord, count(*) AS rows FROM r GROUP BY 1, 2""")
def attempt_collapse(spark, sf_dir):
    return ev.collapse_attempts(analogs.events(spark, sf_dir), "purchase", "signup")


LATEST = "SELECT sid, name, ord, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, ord DESC) AS rn FROM e {where}) WHERE rn = 1"


@query(f"WITH {EVENTS} {LATEST.format(keys='sid', where=chr(32) + 'WHERE name = ' + chr(39) + 'error' + chr(39))}")
def latest_feedback(spark, sf_dir):
    return ev.latest_by(analogs.events(spark, sf_dir).filter("name = 'error'"), ["sid"]).select("sid", "name", "ord", "ts", "value")


@query(f"WITH {EVENTS} {LATEST.format(keys='sid, name', where='')}")
def latest_per_key(spark, sf_dir):
    return ev.latest_by(analogs.events(spark, sf_dir), ["sid", "name"]).select("sid", "name", "ord", "ts", "value")


def _retention_sql(cap: int) -> str:
    return f"""WITH {EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts DESC, ord DESC) AS rn FROM e), p AS (SELECT sid, ord, row_number() OVER (ORDER BY ts DESC, ord DESC) AS place FROM k WHERE rn = 1),
o AS (SELECT sid, ord, row_number() OVER (ORDER BY ts DESC, ord DESC) AS place FROM k WHERE rn > 1)
SELECT sid, ord FROM p WHERE place <= {cap} UNION ALL SELECT sid, ord FROM o WHERE place <= greatest({cap} - (SELECT count(*) FROM p), 0)"""


@query(_retention_sql(3000))
def retention_two_level(spark, sf_dir):
    return ev.retention(analogs.events(spark, sf_dir), "sid", 3000).select("sid", "ord")


@query(_retention_sql(100))
def retention_of_newest(spark, sf_dir):
    """A cap below the number of keys: the newest of them win."""
    return ev.retention(analogs.events(spark, sf_dir), "sid", 100).select("sid", "ord")


@query(f"WITH {EVENTS} SELECT ord, sid, count(*) OVER (PARTITION BY sid ORDER BY ts RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS recent FROM e")
def rolling_60s_count(spark, sf_dir):
    return ev.rolling_count(analogs.events(spark, sf_dir), "sid", 60_000)


@query(f"WITH {EVENTS}, b AS (SELECT *, lag(sha256(name)) OVER (PARTITION BY sid ORDER BY ord) AS before FROM e) SELECT sid, ord, name FROM b WHERE before IS DISTINCT FROM sha256(name)")
def consecutive_dedupe(spark, sf_dir):
    return ev.run_starts(analogs.events(spark, sf_dir), "sid", F.sha2("name", 256)).select("sid", "ord", "name")


@query(f"""WITH {EVENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ord DESC) AS rn FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY value DESC, ord DESC) AS slow, count(*) OVER (PARTITION BY sid) AS n FROM l WHERE rn <= 50)
SELECT sid, quantile_disc(value, 0.95) AS p95, count(*) AS samples FROM k WHERE slow > floor(n * 0.1) GROUP BY 1""")
def trimmed_recent_p95(spark, sf_dir):
    return st.trimmed_recent_p95(analogs.events(spark, sf_dir), "sid", "value", "ord", recent=50, trim=0.1)


@query(f"WITH {EVENTS} SELECT name, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS lower_median FROM e GROUP BY 1")
def percentile_nearest_rank(spark, sf_dir):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return analogs.events(spark, sf_dir).groupBy("name").agg(disc(0.95).alias("p95"), disc(0.5).alias("lower_median"))


@query()
def min_interval_downsample(spark, sf_dir):
    return windows.spaced(analogs.events(spark, sf_dir), "sid", 6 * 3_600_000)


@query()
def exposure_windows(spark, sf_dir):
    return windows.exposure_windows(analogs.events(spark, sf_dir), "signup")
