"""Infilling, URL rules and hard negatives against plain versions, over edge cases."""

import hashlib
import math
import re

import pytest

from tests.llm import brute
from tests.oracle import spark_rows, sql_rows
from tidemark.llm import infill, negatives, queries, url_rules

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_displacement_scatter", "op12_interval_sweep", "op13_packed_products"])
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, SF))
    wanted_columns, wanted = sql_rows(SF, queries.ORACLE_SQL[name])
    assert columns == wanted_columns
    assert len(rows) == len(wanted) > 0
    assert rows == wanted


def infilled(doc_id, text, seed=42, rate=50, suffix_first=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if h[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


HARD_TEXTS = [None, "", " ", "\n\t ", "one", " one", "one ", "a b", "é€😀 ü", "<P> held", "x<S>", "<M>", "< P>", "<P", "a <", "<S", "S> b <", "P>M>S>", "a\u00a0b\u2003c", "\x0b\x0c\r\n x \x1c y", "very long " * 300_000]


@pytest.mark.parametrize("rate, suffix_first", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_infilling(spark, monkeypatch, rate, suffix_first):
    rows = [(i, t) for i in (None, -7, *range(6)) for t in (HARD_TEXTS if i in (1, 2) else HARD_TEXTS[:-1])]
    table = spark.createDataFrame([(*r, "plain", "o", 0, "r") for r in rows + rows[:9]], "doc_id long, text string, form string, output string, n int, restored string").repartition(3)
    out = infill.fill_in_middle(table, rate=rate, suffix_first=suffix_first)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(i, *infilled(i, t, 42, rate, suffix_first)) for i, t in rows + rows[:9]], key=repr)
    back = infill.restore(out.withColumn("restored", out["n"]))
    assert back.columns == ["doc_id", "n", "prefix_chars", "middle_chars", "restored"]
    assert sorted((r["restored"] for r in back.collect())) == sorted(t or "" for _, t in rows + rows[:9])
    assert infill.restore(infill.fill_in_middle(table.limit(0))).count() == 0


def test_shifts_over_many_tiles(monkeypatch):
    import numpy as np

    monkeypatch.setattr(infill, "TILE", 3)
    tiles = list(infill.shifts(10, np.array([0, 2, 2, 7, 10]), np.array([5, 1, -2, 0, 9])))
    assert [len(a) for a, _ in tiles] == [3, 3, 3, 1]
    assert np.concatenate([b - a for a, b in tiles]).tolist() == [5, 5, -2, -2, -2, -2, -2, 0, 0, 0]


def test_outputs_that_are_damaged_restore_to_null(spark):
    rows = [("psm", "<P>a<S>b<M>"), ("psm", "<P>a<S>b"), ("spm", "<P>a<S>b<M>"), ("psm", "x<P>a<S>b<M>"), ("psm", None), (None, "t"), ("plain", None), ("plain", "<P>")]
    table = spark.createDataFrame(rows, "form string, output string")
    assert [r["restored"] for r in infill.restore(table).collect()] == ["ab", None, None, None, None, None, "", "<P>"]


URLS = [
    None, "", "no scheme/en/", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?x=/", "http://example.net/en/1", "http://sub.example.net/en/", "http://xexample.net/en/", "http://example.net/EN/",
    "http://example.com/de/x#y", "http://b.example.com/de", "http://org/fr/", "http://a.b.c.org/fr/x", "http://-net/", "http://a.net./", "http://net.", "http://.net/", "a://b://net/", "http://exa\nmple.net/en/\nx", "http://u@example.net:80/en/",
    "http://Ünï.net/", "http://net!a.net/", "http://example.net-/en/", "http://a..net/", "http://example.net/en/" + "x" * 50_000, "http://" + "a." * 3000 + "org/fr/",
]
RULES = [*queries.URL_RULES, ("example.net", "/en/1", "block"), ("sub.example.net", "/", "block"), ("net", "/", "allow"), ("c.org", "", "block"), ("C.ORG", "/fr/", "allow"), (None, "/zz", "block"), ("b.c.org", "/f", None)]


def judged(url, rules, default):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = raw.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
    fits = []
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if (not h or host == h or host.endswith(f".{h}")) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), v or "", p, h + p))
    return (host, path, max(fits)[4], max(fits)[2]) if fits else (host, path, None, default)


@pytest.mark.parametrize("rules", [RULES, queries.URL_RULES, [("", "", "block")], []])
def test_url_rules(spark, rules):
    rows = [(i % 5 or None, u) for i, u in enumerate(URLS * 2)]
    table = spark.createDataFrame([(*r, "h", "p", "k", 7, 0) for r in rows], "page_id long, url string, host string, path string, key string, level int, block int")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(map(tuple, url_rules.judge(table, given, default="ask").collect()), key=repr)
    assert got == sorted([(i, *judged(u, rules, "ask")) for i, u in rows], key=repr)
    assert url_rules.judge(table.limit(0), given).count() == 0


def mined(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    usable = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        levels = [math.floor(scale * x) for x in v]
        if max(map(abs, levels), default=0) < math.sqrt(2**61 / max(1, len(v))):
            usable.append((i, levels, label))
    order, out = lambda s: (-s[0], s[1] is None, s[1] or 0), []
    for k, (i, a, label) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b, strict=True)), j, other) for m, (j, b, other) in enumerate(usable) if m != k and len(b) == len(a)]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=order)[:negatives]
            out += [(i, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def random_vectors(n, dim, size=1.0, labels=3):
    import random

    draw = random.Random(5)
    return [(i, [draw.gauss(0.3, 1) * size for _ in range(dim)], draw.randrange(labels)) for i in range(n)]


EDGES = [
    (None, [1.0, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [None, 1.0], 1), (6, None, 1), (7, [1.0, 1.0], None), (0, [], 1), (8, [], 1), (9, [], 2),
    (50, [1.0, 2.0, 3.0], 1), (51, [1.0, 2.0, 3.0], 1), (52, [1.0, 2.0, 2.0], 2), (53, [1.0, 2.0, 2.0], 2), (54, [1.0, 2.0, 2.0], 2), (55, [1.0, 2.0, 2.0], 2), (56, [1e30, 0.0, 0.0], 2), (57, [3e6, 2.0, 1.0], 1),
    (-50, [2.0, 2.0], 1), (100, [2.0, 2.0], 1), (100, [2.0, 2.0], 1), (101, [1.0, 1.5], 0), (101, [1.0, 1.5], 0), (150, [0.0, 0.0], 0), (151, [0.0, 0.0], 0), (152, [0.0, 0.0], 5), (200, [-1.0, -1.0], 0), (201, [1.0, 1.0], 9),
]


@pytest.mark.parametrize("case", ["edges", "random", "large", "ties"])
def test_hard_negatives(spark, monkeypatch, case):
    monkeypatch.setattr(negatives, "CUT", 64)
    rows = {"edges": EDGES, "random": random_vectors(300, 7), "large": random_vectors(150, 3, 1e6), "ties": [(i, [1.0, 0.5 + (i % 3) / 4], i % 2) for i in range(301)]}[case]
    table = spark.createDataFrame([(*r, 1, 2, "l") for r in rows], "vec_id long, embedding array<double>, label int, node int, place int, levels string").repartition(5)
    got = sorted(map(tuple, negatives.hard_negatives(table, every=10 if case == "random" else 50).collect()), key=repr)
    wanted = mined(rows, every=10 if case == "random" else 50)
    assert got == wanted and got
    assert negatives.hard_negatives(table.limit(0)).count() == 0


def test_fields_hold_the_largest_sums():
    import numpy as np

    draw = np.random.default_rng(1)
    for dim in (1, 2, 64):
        most = int(math.sqrt(2**61 / dim)) - 1
        levels = draw.integers(-most, most, (2 * negatives.FIELDS + 5, dim), endpoint=True)
        levels[0], levels[1] = most, -most
        packed = negatives.Packed(levels, most)
        assert len(packed.wide) == 3
        for anchor in ([most] * dim, [-most] * dim, levels[7].tolist()):
            wanted = [sum(a * b for a, b in zip(anchor, row, strict=True)) for row in levels.tolist()]
            assert packed.scores(anchor, 0, len(levels)).tolist() == wanted
            assert packed.scores(anchor, 2040, 2060).tolist() == wanted[2040:2060]
