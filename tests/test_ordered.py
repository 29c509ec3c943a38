"""Exposures and snapshot lifetimes: the stream against the log for several cuts, the log against plain rules."""

import random

import pytest
from pyspark.sql import Row

from tests.oracle import as_rows
from tidemark.streaming import exposures, lifetimes
from tidemark.streaming.exposures import Exposures

SCHEMA = "sid long, ord long, ts long, kind string, opportunity string, task string, arm string, mode string, surface string, paths array<string>, path string"
MINUTE = 60_000
FIELDS = [c.split()[0] for c in exposures.EVENTS.split(", ")]


def steps(seed, n=400, sessions=3):
    """Bursts of opens, touches and prompts, with pauses of up to an hour and one of ten days."""
    draw, rows, now = random.Random(seed), [], 1_700_000_000_000
    for k in range(n):
        now += 10 * 24 * 60 * MINUTE if k == n * 3 // 4 else draw.choice([1, 1, 1, 500, MINUTE, 7 * MINUTE]) if draw.random() < 0.97 else 61 * MINUTE
        sid, kind = draw.randrange(sessions), draw.choices(["open", "read", "mutation", "prompt", "close", "odd"], [6, 4, 4, 0.2, 0.5, 0.2])[0]
        op = f"o{draw.randrange(60)}"
        paths = [f"p{draw.randrange(6)}" for _ in range(draw.randrange(4))] if kind == "open" else None
        opens = (op, f"t{draw.randrange(50)}", draw.choice(["armed", "holdback", "armed", "other"]), draw.choice(["randomized", "forced", None]), draw.choice(["prompt", "prompt", None]), paths, None)
        rows.append((sid, k, now, kind, *(opens if kind == "open" else (op if kind == "close" else None, None, None, None, None, None, f"p{draw.randrange(6)}" if kind in ("read", "mutation") else None))))
    return rows


def burst(sid):
    """More opens than windows, one of them closed by name."""
    own = [(sid, k, 1_700_000_000_000 + k, "open", f"o{k}", f"t{k}", "armed", "forced", "s", ["a"], None) for k in range(20)]
    return [*own, (sid, 20, 1_700_000_000_030, "close", "o9", *[None] * 6)]


def run(rows):
    """The machine over each session's rows, without Spark, its state stored and loaded between rows."""
    out = []
    for sid in sorted({r[0] for r in rows}):
        held = []
        for r in sorted((r for r in rows if r[0] == sid), key=lambda r: (r[2], r[1])):
            m = Exposures()
            m.load(held)
            out += [(sid, *x) for x in m.take(Row(*[c.split()[0] for c in SCHEMA.split(", ")])(*r))]
            held = m.dump()
        m = Exposures()
        m.load(held)
        out += [(sid, *x) for x in m.expire(1 << 62)]
    return out


def test_rules():
    row = lambda k, ts, kind, **more: Row("ord", "ts", "kind", "opportunity", "task", "arm", "mode", "surface", "paths", "path")(k, ts, kind, *(more.get(c) for c in ("opportunity", "task", "arm", "mode", "surface", "paths", "path")))
    start = lambda k, ts, name=None: row(k, ts, "open", opportunity=name or f"o{k}", task=f"t{k}", arm="armed", mode="forced", surface="s", paths=["a", "b"])
    named = lambda events: [(e[1], e[2], e[0], e[9]) for e in events]
    m = Exposures()
    opened = [x for k in range(17) for x in m.take(start(k, k))]
    assert named(opened)[-2:] == [("closed", "o0", 16, "capacity"), ("opened", "o16", 16, None)]
    assert named(m.take(start(20, 17, "o0"))) == [("deduped", "o0", 17, "exact_opportunity")]
    again = m.take(row(21, 18, "open", opportunity="new", task="t5", arm="armed", surface="s", paths=["a"]))
    assert named(again) == [("deduped", "new", 18, "task_already_enrolled")] and again[0][-2:] == (True, "o5")
    m.take(row(22, 20, "read", path="a"))
    m.take(row(23, 21, "mutation", path="a"))
    m.take(row(24, 22, "mutation", path="b"))
    assert named(m.take(row(25, 23, "close", opportunity="o3"))) == [("closed", "o3", 23, "caller")]
    touched = [x for k in range(5) for x in m.take(row(30 + k, 30 + k, "read", path="z"))]
    assert len(touched) == 15 and {x[9] for x in touched} == {"touch_limit"} and touched[0][0] == 34
    assert touched[0][10:15] == (True, True, True, 1, 8)
    m.take(start(40, 100))
    assert named(m.take(row(41, 100 + exposures.WINDOW_MS, "read", path="a"))) == [("closed", "o40", 100 + exposures.WINDOW_MS, "timeout")]
    m.take(start(42, 10_000_000))
    assert named(m.take(row(43, 10_000_001, "prompt"))) == [("closed", "o42", 10_000_001, "next_prompt")]
    assert named(m.take(start(44, 10_000_001 + exposures.STATE_MS + 1, "o0")))[0][0] == "opened"
    for k in range(200):
        m.take(start(1000 + k, 10_000_002 + exposures.STATE_MS + k))
    assert len(m.seen) == exposures.SEEN and len(m.windows) == exposures.WINDOWS and {w["opportunity"] for w in m.windows} <= {s["opportunity"] for s in m.seen}


def test_log_equals_the_machine(spark):
    rows = steps(1) + steps(2, 300, 5) + burst(99)
    wanted = run(rows)
    assert {r[10] for r in wanted} >= {None, "touch_limit", "timeout", "capacity", "next_prompt", "caller", "exact_opportunity", "task_already_enrolled"}
    got = exposures.exposure_log(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert as_rows(FIELDS, [tuple(r) for r in got.collect()]) == as_rows(FIELDS, wanted)
    assert exposures.exposure_log(spark.createDataFrame([], SCHEMA)).count() == 0


def streamed(spark, tmp_path, parts, schema, stream):
    """Rows that a stream gives for these batches, one file each; the last moves the watermark beyond all others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            query = stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert not query.isActive
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return [tuple(r) for r in spark.read.parquet(out).collect()]


@pytest.mark.parametrize("cuts", [[200], [1, 90, 91, 250, 330]])
def test_stream_equals_the_log(spark, tmp_path, cuts):
    rows = steps(3) + burst(99)
    order = sorted(rows, key=lambda r: r[2] + random.Random(r[1]).randrange(5 * MINUTE))  # arrives late, within the delay
    parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)]
    end = [(-1, 0, max(r[2] for r in rows) + 30 * 24 * 60 * MINUTE, "odd", *[None] * 7)]
    got = streamed(spark, tmp_path, [*parts, end], SCHEMA, exposures.exposure_stream)
    assert as_rows(FIELDS, got) == as_rows(FIELDS, run(rows))


SNAPSHOTS = "repo long, ord long, ts long, agent string, generation long"


def snapshots(n=300):
    draw, now, out = random.Random(9), 1_700_000_000_000, []
    for k in range(n):
        now += draw.choice([0, MINUTE, 30 * MINUTE, 3 * 60 * MINUTE]) if k % 100 < 90 else 1
        out.append((draw.randrange(2), k, now, f"a{draw.randrange(8) if k % 50 else k}", draw.randrange(3)))
    return out


def plain_lifetimes(rows, stored):
    out = []
    for repo in sorted({r[0] for r in rows}):
        live = []
        for _, _, ts, agent, generation in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2], r[1])):
            out += [(repo, a, t, g, t + lifetimes.TTL_MS, "expired") for t, g, a in live if ts - t > lifetimes.TTL_MS]
            live = sorted(x for x in [*live, (ts, generation, agent)] if ts - x[0] <= lifetimes.TTL_MS)
            while len(live) > stored:
                # the oldest that isn't its agent's newest, else the oldest
                gone = next((x for k, x in enumerate(live) if x[2] in {y[2] for y in live[k + 1 :]}), live[0])
                live.remove(gone)
                out.append((repo, gone[2], gone[0], gone[1], ts, "cap"))
        out += [(repo, a, t, g, t + lifetimes.TTL_MS, "expired") for t, g, a in live]
    return out


ENDS = [c.split()[0] for c in lifetimes.ENDS.split(", ")]


@pytest.mark.parametrize("stored", [2048, 10, 3])
def test_lifetimes(spark, stored):
    rows = snapshots()
    wanted = plain_lifetimes(rows, stored)
    assert len(wanted) == len(rows) and (stored > 100 or {"cap", "expired"} == {w[5] for w in wanted})
    got = lifetimes.lifetime_log(spark.createDataFrame(rows, SNAPSHOTS), stored=stored)
    assert as_rows(ENDS, [tuple(r) for r in got.collect()]) == as_rows(ENDS, wanted)


def test_lifetimes_as_a_stream(spark, tmp_path):
    rows = snapshots(120)
    end = [(-1, 0, rows[-1][2] + 30 * 24 * 60 * MINUTE, "x", 0)]
    got = streamed(spark, tmp_path, [rows[:50], rows[50:51], rows[51:], end], SNAPSHOTS, lambda s: lifetimes.lifetime_stream(s, stored=10))
    assert as_rows(ENDS, got) == as_rows(ENDS, plain_lifetimes(rows, 10))
