"""Readers on small files, and the rules of imports and exports on sources that SQL's analogs don't have."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import imports
from tidemark.sources import readers


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.js": "x", "lib/b.ts": "import './c'", "lib/.hidden.js": "h", "node_modules/m.js": "m", "big.js": "y" * (readers.MOST_BYTES + 1), "note.txt": "n", ".git/c.js": "c"}.items():
        file = tmp_path / path
        file.parent.mkdir(exist_ok=True)
        file.write_text(text)
    return tmp_path


def test_scan_tree_and_skip(spark, tree):
    found = readers.scan_tree(spark, str(tree), ["*.js", "*.ts"])
    assert {r["path"]: r["source"] for r in found.collect()} == {"a.js": "x", "lib/b.ts": "import './c'", "big.js": None}
    seen = spark.createDataFrame(found.select("path", "mtime", "size").collect(), "path string, mtime timestamp, size long")
    (tree / "a.js").write_text("changed")
    (tree / "lib/o d[d]{1}*.js").write_text("odd")
    again = readers.scan_tree(spark, str(tree), ["*.js", "*.ts"], previous=seen)
    assert {r["path"]: r["source"] for r in again.collect()} == {"a.js": "changed", "lib/o d[d]{1}*.js": "odd"}
    assert len(again.inputFiles()) == 2  # the others aren't opened
    now = spark.createDataFrame(readers.scan_tree(spark, str(tree), ["*.js", "*.ts"]).select("path", "mtime", "size").collect(), "path string, mtime timestamp, size long")
    assert readers.scan_tree(spark, str(tree), ["*.js", "*.ts"], previous=now).count() == 0


def test_git_logs(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x01COMMIT\x01aaa\nsrc/a.js\nsrc/b.js\n\n\x01COMMIT\x01bbb\n\n\x01COMMIT\x01ccc\nsrc/a.js\n")
    assert {(r["hash"], tuple(r["files"])) for r in readers.commits_of_log(spark, str(log)).collect()} == {("aaa", ("src/a.js", "src/b.js")), ("bbb", ()), ("ccc", ("src/a.js",))}
    log.write_text("1700000300\nb.js\na.js\n\n1700000200\na.js\nc.js\n\n1700000100\nd.js\n")
    assert [tuple(r) for r in readers.recent_files(spark, str(log), 3).collect()] == [("a.js", 1700000300), ("b.js", 1700000300), ("c.js", 1700000200)]
    log.write_text("\x01COMMIT\x01aaa\nA\tx.js\nM\ty.js\nD\tz z.js\n\n\x01COMMIT\x01bbb\nA\tz z.js\n")
    changes = readers.file_changes(spark, str(log)).orderBy("block", "n", "place").collect()
    assert [(r["hash"], r["status"], r["file"]) for r in changes] == [("aaa", "A", "x.js"), ("aaa", "D", "z z.js"), ("bbb", "A", "z z.js")]


def test_event_logs(spark, tmp_path):
    schema, logs = "ts long, name string", {}
    for root in ("one", "two"):
        logs[root] = str(tmp_path / f"{root}.jsonl")
        (tmp_path / f"{root}.jsonl").write_text('{"ts": 3, "name": "coherence.x"}\nnot json\n{"ts": 4, "name": "scan"}\n')
    (tmp_path / "one.jsonl.old").write_text('{"ts": 9, "name": "old"}\n{"ts": 1, "name": "older"}\n')
    rows = readers.read_events(spark, logs["one"], schema).orderBy("generation", "block", "n").collect()
    assert [r["name"] for r in rows] == ["old", "older", "coherence.x", "scan"]
    assert readers.read_events(spark, logs["one"], schema, with_old=False).count() == readers.read_events(spark, logs["two"], schema).count() == 2
    pooled = readers.pooled_events(spark, logs, schema, exposed=["two"]).orderBy("ts", "root", "generation", "block", "n").collect()
    assert [(r["ts"], r["root"], r["name"]) for r in pooled] == [(1, "one", "older"), (3, "two", "coherence.x"), (4, "one", "scan"), (4, "two", "scan"), (9, "one", "old")]


def test_transcripts(spark, tmp_path):
    for path, lines in {"p/s.jsonl": ['{"type": "user"}', "", '{"type": "tool", "x": "[graph]"}', "broken"], "p/subagents/t.jsonl": ['{"type": "user"}']}.items():
        file = tmp_path / path
        file.parent.mkdir(exist_ok=True)
        file.write_text("\n".join(lines))
    own = readers.transcripts(spark, str(tmp_path))
    assert readers.transcripts(spark, str(tmp_path), nested=True).count() == own.count() + 1 == 4
    marks = {r["type"]: (r["records"], r["graph"]) for r in readers.transcript_markers(own, {"graph": "[graph]"}).collect()}
    assert marks == {"user": (1, False), "tool": (1, True), "(none)": (1, False)}


def test_search_hits(spark):
    line = lambda text, n, name=False: {"Line": base64.b64encode(text.encode()).decode(), "LineNumber": n, "FileName": name}
    files = [{"FileName": "a.js", "Score": 2.5, "LineMatches": [line("let é = 1\n", 7), line("a.js", 0, True)]}, {"FileName": ".env", "Score": 9.0, "LineMatches": [line("KEY", 1)]}, {"FileName": "none", "Score": 1.0, "LineMatches": None}]
    table = spark.createDataFrame([(json.dumps({"Result": {"Files": files}}),), ("{}",), ("broken",), (None,)], "response string")
    assert [(r["path"], r["line_no"], r["line"].strip(), r["score"]) for r in readers.search_hits(table, F.col("path").endswith(".env")).collect()] == [("a.js", 7, "let é = 1", 2.5)]


def test_health_history(spark):
    rows = [("r", t, t / 10 if t % 4 else None, t) for t in range(130)] + [("s", 5, 1.0, 2)]
    got = {r["root"]: r for r in readers.health_history(spark.createDataFrame(rows, "root string, ts long, resolution double, files long")).collect()}
    assert (got["r"]["kept"], got["r"]["first_ts"], got["r"]["last_ts"]) == (100, 30, 129)
    assert got["r"]["files_trend"] == list(range(110, 130)) and got["r"]["resolution_trend"][:3] == [11.0, 11.1, 0.0]
    assert got["s"]["files_trend"] == [2]


def test_imports_and_exports(spark):
    source = "/* import 'no' */\n// import 'no'\nimport a, {\n  b\n} from \"./a\"\nexport * from './all'\nconst l = await import( './lazy' ), r = require('./r')\nexport { x as y, z }\nexport { q } from './q'\nmodule.exports = 1\nexports.k = 2\nimport './side'\nimport './side'"
    table = spark.createDataFrame([(1, source), (2, None), (3, "")], "id long, source string")
    assert sorted((r["kind"], r["specifier"]) for r in imports.import_rows(table).collect()) == [("dynamic", "./lazy"), ("export-from", "./all"), ("export-from", "./q"), ("import", "./a"), ("import", "./side"), ("require", "./r")]
    assert sorted((r["kind"], r["name"]) for r in imports.export_rows(table).collect()) == [("cjs-default", "default"), ("cjs-named", "k"), ("named", "y"), ("named", "z")]


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b.js", "src/c/index.js", "src/c.tsx", "lib/d.json", "x.py")], "path string")
    wanted = {
        ("src/a.ts", "./b.js"): "src/b.js", ("src/a.ts", "./a.js"): "src/a.ts", ("src/b.js", "./a.js"): None, ("src/b.js", "./a"): "src/a.ts", ("src/b.js", "./c"): "src/c.tsx", ("src/b.js", "./c/"): "src/c.tsx", ("src/c.tsx", "./c/index"): "src/c/index.js",
        ("src/c/index.js", "../../lib/d"): "lib/d.json", ("src/c/index.js", ".."): None, ("src/b.js", "../../out"): None, ("src/b.js", "react"): None, ("x.py", "./src/../lib/d.json"): "lib/d.json",
    }
    got = imports.resolved(spark.createDataFrame(list(wanted), "importer string, specifier string"), files).collect()
    assert {(r["importer"], r["specifier"]): r["to_path"] for r in got} == wanted
    assert {r["specifier"] for r in got if r["kind"] == "external"} == {"react"}
