"""Canonical JSON against a plain version, and the rotating log."""

import json
import math
import random
from decimal import Decimal

import pytest

from tidemark.functions import canonical
from tidemark.sources import rotating


def number(x):
    d = float(x)
    if d == 0 or not math.isfinite(d):
        return "0" if d == 0 else "null"
    sign, digits, exponent = Decimal(repr(abs(d))).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    point = len(digits) + exponent
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + (f".{digits[1:]}" if n > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return ("-" if d < 0 else "") + out


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, list):
        return f"[{','.join(map(plain, value))}]"
    return "{" + ",".join(f"{plain(k)}:{plain(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode("utf-16-be"))) + "}"


def made(draw, depth=0):
    kind = draw.randrange(9 if depth < 4 else 6)
    if kind >= 7:
        return {draw.choice(["b", "a", "", "Z", "é", "10", "9", "\U0001f600", "￮", 'q"', "x y"]) + str(draw.randrange(3)): made(draw, depth + 1) for _ in range(draw.randrange(5))}
    if kind == 6:
        return [made(draw, depth + 1) for _ in range(draw.randrange(4))]
    return [None, draw.random() < 0.5, draw.choice(["", "tab\t", "nul\x00\x1f\x0b", 'q"\\', "\\u001A", "é€😀", "1.0", "a/b", "\x7f"]), draw.randrange(-(10**6), 10**6), draw.uniform(-1, 1) * 10 ** draw.randrange(-12, 25), draw.choice([1.0, -0.0, 1e21, 1e-7, 123456789012345680000, 0.1, 5e-324, 1.5e300])][kind]


def test_canonical_json(spark):
    draw = random.Random(4)
    values = [made(draw) for _ in range(400)]
    texts = [json.dumps(v, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])) for v in values]
    extra = {"": None, "{": None, "not json": None, '{"a":1,"a":2}': None, None: None, " [1.0, 1e2 ,-0,1E+2] ": "[1,100,0,100]", '"a"': '"a"', '{"b":{"d":1,"c":[{"z":0,"y":1}]},"a":null}': '{"a":null,"b":{"c":[{"y":1,"z":0}],"d":1}}'}
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *extra])], "k int, t string").repartition(4)
    got = {r["k"]: r["c"] for r in table.select("k", canonical.canonical_json(table["t"]).alias("c")).collect()}
    wanted = [*map(plain, values), *extra.values()]
    assert [got[k] for k in range(len(wanted))] == wanted


def test_unique_sorted(spark):
    rows = [(1, 3, '{"b":1,"a":2}'), (1, 1, '{"a": 2.0, "b": 1}'), (1, 2, "[]"), (1, 4, "no"), (2, 5, "[ ]"), (1, 6, None)]
    got = canonical.unique_sorted(spark.createDataFrame(rows, "task int, ord int, finding string"), "task", "ord", "finding").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "[]", 2, "[]", 1), (1, 2, '{"a":2,"b":1}', 1, '{"a": 2.0, "b": 1}', 2), (2, 1, "[]", 5, "[ ]", 1)]


SCHEMA = "ts long, name string, payload struct<tool: string, n: long>"


def rows(first, last):
    return [(k, f"event é {k}", ("search" if k % 2 else None, k)) for k in range(first, last)]


def test_batches_rotate(spark, tmp_path):
    rotating.register(spark)
    path = str(tmp_path / "log")
    add = lambda a, b: spark.createDataFrame(rows(a, b), SCHEMA).repartition(3).write.format("rotating_json").option("path", path).option("maxBytes", 2000).mode("append").save()
    seen = lambda: sorted((r["ts"], r["name"], (r["payload"]["tool"], r["payload"]["n"])) for r in rotating.read(spark, path, SCHEMA).collect())
    assert seen() == []
    add(0, 50)
    assert seen() == rows(0, 50)
    add(50, 60)  # the first generation is too large: it is the old one now
    add(60, 70)
    assert seen() == rows(0, 70)
    add(70, 120)
    add(120, 130)
    assert seen() == rows(50, 130)
    add(130, 130)
    state = rotating.manifest(path)
    assert {p.name for p in (tmp_path / "log").iterdir()} == {*state["old"], *state["current"], rotating.MANIFEST}
    with pytest.raises(Exception, match="only appends"):
        spark.createDataFrame(rows(0, 1), SCHEMA).write.format("rotating_json").option("path", path).mode("overwrite").save()


def test_a_stream_and_batches_that_come_again(spark, tmp_path):
    rotating.register(spark)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    for k in range(3):
        spark.createDataFrame(rows(10 * k, 10 * k + 10), SCHEMA).coalesce(2).write.mode("append").parquet(source)
        spark.readStream.schema(SCHEMA).parquet(source).writeStream.format("rotating_json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    seen = lambda: sorted(r["ts"] for r in rotating.read(spark, path, SCHEMA).collect())
    assert seen() == list(range(30))
    writer = rotating._StreamWriter(path, rotating.MAX_BYTES)
    last = rotating.manifest(path)["batch"]
    row = spark.createDataFrame(rows(99, 100), SCHEMA).first()
    writer.commit([writer.write(iter([row])), None], last)  # a batch that was committed before its checkpoint
    assert seen() == list(range(30))
    writer.abort([writer.write(iter([row]))], last + 1)
    assert seen() == list(range(30))
    writer.commit([writer.write(iter([row]))], last + 1)
    assert seen() == [*range(30), 99]
    state = rotating.manifest(path)
    assert {p.name for p in (tmp_path / "log").iterdir()} == {*state["old"], *state["current"], rotating.MANIFEST}
