"""Stateful and incremental forms, and queries without SQL, against plain versions."""

from pyspark.sql import functions as F

from tidemark.functions.statistics import permutation_lift
from tidemark.streaming import windows

ROWS = [(s, k, k * 400_000 + s * 7, "open" if (k * s) % 5 == 1 else "touch") for s in range(1, 6) for k in range(60)]


def plain_windows(rows):
    out = []
    for sid in sorted({r[0] for r in rows}):
        opened, touches = None, 0
        for _, _, ts, name in sorted(r for r in rows if r[0] == sid):
            if opened is not None and ts - opened >= windows.MAX_MS:
                out.append((sid, opened, opened + windows.MAX_MS, touches, "time"))
                opened = None
            if opened is None:
                opened, touches = (ts, 0) if name == "open" else (None, 0)
                continue
            touches += 1
            if touches == windows.MAX_TOUCHES:
                out.append((sid, opened, ts, touches, "touches"))
                opened = None
        if opened is not None:
            out.append((sid, opened, opened + windows.MAX_MS, touches, "end"))
    return sorted(out)


def test_exposure_windows(spark):
    events = spark.createDataFrame(ROWS, "sid long, ord long, ts long, name string").repartition(5)
    wanted = plain_windows(ROWS)
    assert {w[4] for w in wanted} >= {"time", "end"}
    assert sorted(map(tuple, windows.exposure_windows(events, "open").collect())) == wanted
    dense = [(s, k, k * 60_000, n) for s, k, _, n in ROWS]
    assert "touches" in {w[4] for w in plain_windows(dense)}
    assert sorted(map(tuple, windows.exposure_windows(spark.createDataFrame(dense, events.schema), "open").collect())) == plain_windows(dense)


def test_spaced(spark):
    events = spark.createDataFrame(ROWS, "sid long, ord long, ts long, name string")
    wanted = []
    for sid in range(1, 6):
        last = None
        for ts in sorted(r[2] for r in ROWS if r[0] == sid):
            if last is None or ts - last >= 1_000_000:
                wanted.append((sid, ts))
                last = ts
    assert sorted(map(tuple, windows.spaced(events, "sid", 1_000_000).collect())) == sorted(wanted)


def test_upsert_and_follow(spark, tmp_path):
    current = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "path string, v int")
    batch = spark.createDataFrame([("b", 9), ("c", 4)], "path string, v int")
    assert sorted(map(tuple, windows.upsert_files(current, batch).collect())) == [("a", 1), ("b", 9), ("c", 4)]
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int").coalesce(1).write.parquet(source)
    stream = lambda: windows.follow(spark.readStream.schema("path string, v int").parquet(source), table, str(tmp_path / "checkpoint"))
    stream().awaitTermination()
    spark.createDataFrame([("b", 5)], "path string, v int").coalesce(1).write.mode("append").parquet(source)
    stream().awaitTermination()
    seen = lambda: sorted(map(tuple, windows.followed(spark, table, "path string, v int").collect()))
    assert seen() == [("a", 1), ("b", 5)]
    stream().awaitTermination()  # nothing new
    for k in range(3):
        spark.createDataFrame([("b", k), (f"c{k}", k), ("b", 10 + k)], "path string, v int").coalesce(1).write.mode("append").parquet(source)
        stream().awaitTermination()
    assert seen() == [("a", 1), ("b", 12), ("c0", 0), ("c1", 1), ("c2", 2)]
    data = {p.name for p in (tmp_path / "table" / "data").iterdir() if p.name.isdigit()}
    # the first batch still holds a; of b's versions the last two are left
    assert data >= {"0", "3", "4"} and "1" not in data and len([p for p in (tmp_path / "table" / "versions").iterdir() if p.name.isdigit()]) == 2
    assert not (tmp_path / "table" / "data" / "4" / f"_bucket={spark.range(1).select(F.pmod(F.xxhash64(F.lit('a')), F.lit(64))).first()[0]}").exists()
    assert windows.followed(spark, str(tmp_path / "none"), "path string").count() == 0


def test_permutation_lift(spark):
    """With a pool of which each session opens half, the null rate is near a half; injected files that are all opened double it."""
    injected = spark.createDataFrame([(s, k, 2 * k) for s in range(40) for k in range(5)], "session int, slot int, path int")
    opened = spark.createDataFrame([(s, 2 * k) for s in range(40) for k in range(50)], "session int, path int")
    pool = spark.range(100).select(F.col("id").cast("int").alias("path"), F.col("id").alias("number"))
    row = permutation_lift(injected, opened, pool, rounds=50, seed=1).first()
    assert row["rate"] == 1.0 and abs(row["null_rate"] - 0.5) < 0.03 and abs(row["lift"] - 2) < 0.15
