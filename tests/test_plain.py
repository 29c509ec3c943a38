"""Queries without SQL against plain versions on small tables."""

from collections import defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import statistics as st
from tidemark.plans import rank_queries
from tidemark.streaming import windows


def test_permutation_lift_makes_all_rounds(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(st, "permutation_lift", lambda *tables, **options: seen.update(options))
    rank_queries.permutation_lift(spark, "/root/testdata/sf0.001")
    assert seen["rounds"] == 200


def test_permutation_lift(spark):
    injected = [(s, k, (s * 3 + k) % 10) for s in range(6) for k in range(3)]
    opened = [(s, p) for s in range(6) for p in range(10) if (s + p) % 3 == 0] * 2
    table = spark.createDataFrame(injected, "session long, slot int, path long")
    got = st.permutation_lift(table, spark.createDataFrame(opened, "session long, path long"), spark.createDataFrame([(p, p) for p in range(10)], "path long, number long"), rounds=200, seed=7).first()
    hashed = table.select("session", F.explode(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda r: F.xxhash64(F.lit(7), "session", "slot", r))).alias("h")).collect()
    rate = sum((s, p) in opened for s, _, p in injected) / len(injected)
    null = sum((r["session"], r["h"] % 10) in opened for r in hashed) / len(hashed)
    assert len(hashed) == 200 * len(injected)
    assert (got["rate"], got["null_rate"], got["lift"]) == pytest.approx((rate, null, rate / null))


def _events():
    rng, rows = Random(3), []
    for sid in range(5):
        ts = 0
        for o in range(60):
            ts += rng.choice([0, 1_000, 60_000, 600_000])
            rows.append((sid, o, ts, rng.choice(["open", "view", "view", "click"])))
    rng.shuffle(rows)
    return rows


def test_exposure_windows(spark):
    rows = _events()
    wanted = []
    for sid in range(5):
        own = sorted(r[1:] for r in rows if r[0] == sid)
        k = 0
        while k < len(own):
            start = own[k][1]
            if own[k][2] != "open":
                k += 1
                continue
            later = [i for i in range(k + 1, len(own)) if own[i][1] >= start + 1_800_000]
            late, eighth = later[0] if later else len(own), k + 8
            if eighth < late:
                wanted.append((sid, start, own[eighth][1], 8, "touches"))
                k = eighth + 1
            else:
                wanted.append((sid, start, start + 1_800_000, late - k - 1, "time" if later else "end"))
                k = late
    got = windows.exposure_windows(spark.createDataFrame(rows, "sid long, ord long, ts long, name string"), "open").collect()
    assert {r[4] for r in wanted} >= {"touches", "time"}
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_spaced(spark):
    rows = _events()
    times = defaultdict(set)
    for sid, _, ts, _ in rows:
        times[sid].add(ts)
    wanted = []
    for sid, own in times.items():
        last = None
        for ts in sorted(own):
            if last is None or ts - last >= 900_000:
                wanted.append((sid, ts))
                last = ts
    got = windows.spaced(spark.createDataFrame(rows, "sid long, ord long, ts long, name string"), "sid", 900_000).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
