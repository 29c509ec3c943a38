"""What must not grow with the tables: rows gathered for a broadcast, draws that are shuffled, cost of a state machine's step."""

from pyspark.sql import functions as F

from tidemark.functions.text import holding
from tidemark.operators import retrieval


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def gathered(df) -> list[str]:
    """Lines of the plan that stand below a broadcast."""
    out, depth = [], None
    for line in plan(df):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return out


def test_pieces_of_texts_are_not_gathered(spark, tmp_path):
    spark.range(1000).select("id", F.concat(F.lit("src/m"), "id", F.lit("/widget.js")).alias("path")).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    terms = spark.createDataFrame([(1, "Widget"), (1, "m7/"), (2, "m7/"), (2, ""), (2, "é")], "query int, term string")
    met = holding(texts, "path", terms)
    assert "Generate" not in "".join(gathered(met))
    assert sorted((r["query"], r["term"]) for r in met.filter("id = 7").collect()) == [(1, "Widget"), (1, "m7/"), (2, "m7/")]
    assert met.count() == 1002


def test_queries_of_one_term_share_its_files(spark):
    files = spark.createDataFrame([(k, f"a/log{k}.py") for k in range(14)], "id long, path string")
    terms = spark.createDataFrame([(1, "log1", 0), (2, "log1", 0), (2, "log", 1), (3, "LOG7", 0)], "query long, term string, ord int")
    got = sorted((r["query"], r["term"], r["id"]) for r in retrieval.path_layer(terms, files).collect())
    assert got == [(q, "log1", k) for q in (1, 2) for k in (1, 10, 11, 12, 13)] + [(3, "LOG7", 7)]


def test_new_files_with_one_list_of_terms_share_a_search(spark):
    seen = []

    def layers(terms):
        seen.append(sorted(map(tuple, terms.select("query", "term").collect())))
        return [terms.select("query", F.lit(9).cast("long").alias("id"), "term", F.lit(1).alias("layer"), F.lit("path_match").alias("hit_type"), F.lit(60).alias("base"))]

    new = spark.createDataFrame([(k, f"d{k}/{name}.py") for k, name in enumerate(["widget", "widget", "session", "widget"])], "id long, path string")
    exported = spark.createDataFrame([(3, "Other")], "id long, name string")
    files = spark.createDataFrame([(9, "lib/a.py")], "id long, path string")
    fan = spark.createDataFrame([(9, 1)], "id long, fan_in long")
    got = sorted(map(tuple, retrieval.sprawl(new, exported, layers, files, fan).collect()))
    assert got == [(k, "lib/a.py", "path_match", 1) for k in range(4)]
    assert seen == [[(0, "widget"), (2, "session"), (3, "Other"), (3, "widget")]]


def test_blast_radius_tells_of_weak_ties_too(spark):
    """A query that asks for ties that its tables don't have never ranks a partner."""
    from tidemark.plans import registry

    assert registry.QUERIES["blast_radius"](spark, "/root/testdata/sf0.01").filter("size(partners) > 0").count() > 0


def test_spellings_are_read_once(spark):
    from tidemark.functions import canonical

    rows = spark.createDataFrame([(1, 2, '{"b":1,"a":2}'), (1, 1, '{"a":2,"b":1}'), (1, 3, '{"b":1,"a":2}'), (1, 0, "{no"), (2, 5, "[1]")], "task int, ord int, finding string")
    out = canonical.unique_sorted(rows, "task", "ord", "finding")
    first = next(k for k, line in enumerate(reversed(plan(out))) if "HashAggregate" in line or "SortAggregate" in line)
    assert "parse_json" not in "".join(plan(out)[len(plan(out)) - first :])  # nothing is parsed below the first grouping
    assert sorted((r["task"], r["place"], r["ord"], r["finding"], r["copies"]) for r in out.collect()) == [(1, 1, 1, '{"a":2,"b":1}', 3), (2, 1, 5, "[1]", 1)]


def test_a_snapshot_costs_little_however_many_are_kept():
    from collections import namedtuple
    from random import Random
    from time import process_time

    from tidemark.streaming.lifetimes import TTL_MS, Lifetimes

    told, rng = namedtuple("Told", "ts ord agent generation"), Random(5)
    rows = [told(k // 3 * 60_000, k, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None])) for k in range(9000)]

    def plain(stored):
        live, out = [], []
        key = lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or "")
        for r in rows:
            gone = sorted((x for x in live if r.ts - x[0] > TTL_MS), key=key)
            live = [x for x in live if r.ts - x[0] <= TTL_MS] + [(r.ts, r.generation, r.agent)]
            out += [(a, ts, g, ts + TTL_MS, "expired") for ts, g, a in gone]
            newest, rest, seen = [], [], set()
            for x in sorted(live, key=key, reverse=True):
                (rest if x[2] in seen else newest).append(x)
                seen.add(x[2])
            out += [(a, ts, g, r.ts, "cap") for ts, g, a in (newest + rest)[stored:]]
            live = (newest + rest)[:stored]
        return out

    for stored in (2, 200):
        machine = Lifetimes(stored)
        assert [x for r in rows for x in machine.take(r)] == plain(stored)
    many = Lifetimes(4000)
    began = process_time()
    for r in rows:
        many.take(r)
    assert process_time() - began < 2


def test_draws_are_not_shuffled(spark, monkeypatch):
    from tidemark.functions import statistics as st

    monkeypatch.setattr(st, "OPENED", 2)
    injected = spark.createDataFrame([(s, k, (s * 3 + k) % 10) for s in range(6) for k in range(3)], "session long, slot int, path long")
    opened = [(s, p) for s in range(6) for p in range(10) if (s + p) % 3 == 0] * 2
    pool = [(p, p - 1) for p in range(9)] + [(30, 4), (9, 4), (31, 99)]  # one number below 0 and one too high, one three times, some missing
    got = st.permutation_lift(injected, spark.createDataFrame(opened, "session long, path long"), spark.createDataFrame(pool, "path long, number long"), rounds=50, seed=7)
    lines = plan(got)
    for k, line in enumerate(lines):
        if "Generate explode([1,2,3," in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for above in reversed(lines[:k]):
                at = len(above) - len(above.lstrip(" :+-"))
                if at < depth:
                    depth = at
                    assert "hashpartitioning" not in above
    hashed = injected.select("session", F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda r: F.xxhash64(F.lit(7), "session", "slot", r))).alias("h")).collect()
    drawn = [(r["session"], p) in opened for r in hashed for p, n in pool if n == r["h"] % len(pool)]
    assert abs(got.first()["null_rate"] - sum(drawn) / len(drawn)) < 1e-12


def test_layers_gather_terms_not_files_and_stay_short(spark):
    """No plan of the ranking holds those of its layers, and what is broadcast starts from the terms' values."""
    from tidemark.plans import registry

    for name, most in (("layer_path_matches", 60), ("graph_retrieve", 150), ("sprawl_matches", 150)):
        found = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
        assert len(plan(found)) < most, (name, len(plan(found)))
        assert not any("part.parquet" in line or "lineitem.parquet" in line for line in gathered(found)), name


def test_sets_meet_sessions_in_cells_whatever_is_cut(spark, monkeypatch):
    """Draws are made in cells of a block and a slice: no plan deals them out, and cuts of any size give the same sums."""
    from tests.test_lift import cases
    from tidemark.operators import lift

    injections, opens = cases()
    injected = spark.createDataFrame([*injections, (9, 900, 10, [None, "src/f1.js"]), (9, 901, None, ["src/f1.js"])], "repo int, sid long, ord long, files array<string>")
    opened = spark.createDataFrame([*opens, (900, 11, "src/f1.js")], "sid long, ord long, path string")
    for window, resize in ((None, False), (None, True), (5, True)):
        whole = lift.lift(injected, opened, rounds=30, window=window, resize=resize)
        assert not any("explode(sequence(1, 30" in line for line in plan(whole))
        with monkeypatch.context() as m:
            for name, value in (("BLOCK", 3), ("SLAB", 2), ("SLICES", 3), ("SLICE", 2), ("STEP", 7)):
                m.setattr(lift, name, value)
            cut = lift.lift(injected, opened, rounds=30, window=window, resize=resize).first()
        assert cut == whole.first() and cut["opened"] > 0 and cut["null_opened"] > 0


def test_blast_radius_keeps_every_partner(spark, tmp_path):
    """Partners that 5,100 pairs outrank, that only large commits show, or that stand behind others the session has touched."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tests.oracle import spark_rows, sql_rows
    from tidemark.plans import registry

    commits = [(1, [1]), (2, [2]), (3, [3]), *((3, [f]) for f in range(9201, 9205))]  # session, files
    commits += [(10, [1, 9001])] * 3 + [(10, [2, *range(9101, 9108)])] * 3 + [(10, [3, *range(9201, 9206)])] * 4 + [(10, [3, 9206])] * 3
    commits += [(11, [20000 + 2 * k, 20001 + 2 * k]) for k in range(5100) for _ in range(4)]
    items = [(o, f, n) for o, (_, files) in enumerate(commits) for n, f in enumerate(files)]
    order, file, number = map(list, zip(*items))
    pq.write_table(pa.table({"l_orderkey": order, "l_suppkey": file, "l_linenumber": number, "l_partkey": [11] * len(items), "l_returnflag": ["N"] * len(items)}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": list(range(len(commits))), "o_custkey": [session for session, _ in commits]}), tmp_path / "orders.parquet")
    got = registry.QUERIES["blast_radius"](spark, str(tmp_path))
    assert spark_rows(got) == sql_rows(str(tmp_path), registry.ORACLE_SQL["blast_radius"])
    found = {r["session"]: r["partners"] for r in got.collect()}
    assert (found[1], found[2], found[3]) == ([9001], [9101, 9102], [9205, 9206])
    assert not any("BroadcastExchange" in line for line in plan(got))
