"""The lift over sets of other sessions, against a plain version with the same draws."""

import random
from collections import defaultdict

import pytest

from tidemark.operators import lift


def stirred(seed, *parts):
    state = seed
    for part in parts:
        for factor in lift.FACTORS:
            state = (state + part) % lift.MODULUS * factor % lift.MODULUS
    return state


def plain(injections, opens, rounds, seed, window, resize):
    last = defaultdict(int)
    for sid, ord_, path in opens:
        parts = (path or "").split("/")
        for k in range(len(parts)) if path else ():
            end = "/".join(parts[k:])
            last[sid, end] = max(last[sid, end], ord_)
    repos = defaultdict(list)
    for repo, sid, ord_, files in injections:
        repos[repo].append((len(files), sid, ord_, files))
    sums = [0, 0, 0, 0]
    for sets in repos.values():
        if len(sets) < 2:
            continue
        sets.sort(key=lambda s: s[:3])
        strata = [sets[i : i + window] for i in range(0, len(sets), window)] if window else [sets]
        for pool in strata:
            pool = sorted(pool, key=lambda s: s[1:3])
            for size, sid, ord_, files in pool:
                sums[0] += size
                sums[1] += sum(last[sid, f] > ord_ for f in files)
                others = [s for s in pool if s[1] != sid] or pool
                for r in range(1, rounds + 1):
                    drawn = others[stirred(seed, sid, ord_, r) % len(others)][3]
                    if resize and len(drawn) != size:
                        drawn = [drawn[stirred(seed, sid, ord_, r, k) % len(drawn)] for k in range(1, size + 1)] if drawn else []
                    sums[2] += len(drawn)
                    sums[3] += sum(last[sid, f] > ord_ for f in drawn)
    a, b = (100 * sums[k + 1] / sums[k] if sums[k] else None for k in (0, 2))
    return tuple(sums), a, b


def cases():
    draw = random.Random(3)
    name = lambda: f"{draw.choice(['src', 'lib'])}/f{draw.randrange(9)}.js"
    some = [(repo, repo * 100 + s, k * 10, [name() for _ in range(draw.choice([0, 1, 1, 2, 3, 5]))]) for repo in range(4) for s in range(1 + repo * 3) for k in range(1 + (s + repo) % 4)]
    opens = [(sid, ord_ + draw.randrange(-5, 20), draw.choice(["/root/", "", ""]) + name()) for _, sid, ord_, _ in some for _ in range(3)] + [(1, 5, None), (1, 6, "")]
    return some, opens


@pytest.mark.parametrize("window, resize", [(None, False), (None, True), (3, True), (3, False), (1, True)])
def test_lift(spark, window, resize):
    injections, opens = cases()
    sums, a, b = plain(injections, opens, 200, 7, window, resize)
    row = lift.lift(spark.createDataFrame(injections, "repo int, sid long, ord long, files array<string>").repartition(5), spark.createDataFrame(opens, "sid long, ord long, path string"), rounds=200, seed=7, window=window, resize=resize).first()
    assert tuple(row)[:4] == sums and sums[1] > 0 and sums[3] > 0
    assert row["actual_pct"] == pytest.approx(a, abs=0.006) and row["null_pct"] == pytest.approx(b, abs=0.006) and row["lift"] == pytest.approx(a / b, abs=0.006)


def test_lift_of_nothing(spark):
    injections = spark.createDataFrame([(1, 1, 1, ["a"])], "repo int, sid long, ord long, files array<string>")
    opens = spark.createDataFrame([(1, 2, "a")], "sid long, ord long, path string")
    for table in (injections, injections.limit(0)):
        assert tuple(lift.lift(table, opens).first()) == (0, 0, 0, 0, None, None, None)
