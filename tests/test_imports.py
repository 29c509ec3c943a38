"""Imports through path aliases and workspaces, of several repositories at once."""

from tidemark.operators import imports

CONFIG = "repo int, path string, extends string, base_url string, paths array<struct<pattern: string, targets: array<string>>>"


def test_aliases_and_workspaces(spark):
    files = spark.createDataFrame(
        [(1, p) for p in ("src/a.ts", "src/ui/x.tsx", "lib/ui/x.js", "gen/deep.ts", "pkgs/one/src/index.ts", "pkgs/one/util.js", "pkgs/two/main.mjs", "index.ts", "img/logo.png", "src/b.ts", "exact.json", "gen/a-b.ts")] + [(2, "src/a.ts"), (2, "lib/ui/x.js")],
        "repo int, path string",
    )
    configs = spark.createDataFrame([
        (1, "tsconfig.base.json", None, "nowhere", [("@ui/*", ["never/*"])]),
        (1, "tsconfig.json", "./cfg/b", None, [("@ui/*", ["src/ui/*", "lib/ui/*"]), ("late/*", ["src/*"]), ("exact", ["gone", "exact.json"])]),
        (1, "cfg/b.json", "./c.json", ".", [("@ui/*", ["gen/*"]), ("@base", ["src/b"]), ("out/*", ["../../*", "/abs/*"])]),
        (1, "cfg/c.json", "./d", "lost", [("late/a", ["gen/deep"]), ("*-b", ["gen/a-b"])]), (1, "cfg/d.json", "./e", None, []), (1, "cfg/e.json", "./f", None, [("e/*", ["src/*"])]), (1, "cfg/f.json", None, None, [("f/*", ["src/*"])]),
        (2, "jsconfig.json", "@pack/base", "lib", [("@ui/*", ["ui/*"])]), (3, "cfg/x.json", None, None, [("z", ["z"])]),
    ], CONFIG)
    packages = spark.createDataFrame([
        (1, "pkgs/one", "@me/one", None, "", None), (1, "pkgs/two", "two", "./main", "x", None), (1, "pkgs/.dot", "dot", None, None, None), (1, "pkgs/node_modules/q", "q", None, None, None), (1, "other/three", "three", None, None, None), (1, "pkgs/a", "@me/one", None, None, None),
    ], "repo int, dir string, name string, module string, main string, types string")
    globs = spark.createDataFrame([(1, "./pkgs/*"), (1, "pkgs/**/"), (2, "*")], "repo int, glob string")
    wanted = {
        (1, "src/a.ts", "@ui/x"): ("src/ui/x.tsx", "tsconfig"), (1, "src/a.ts", "@ui/x.js"): ("src/ui/x.tsx", "tsconfig"), (1, "src/c.js", "@ui/x.js"): ("lib/ui/x.js", "tsconfig"), (1, "src/a.ts", "@ui/"): (None, "external"), (1, "src/a.ts", "@base"): ("src/b.ts", "tsconfig"), (1, "src/a.ts", "@base/x"): (None, "external"),
        (1, "src/a.ts", "late/a"): ("gen/deep.ts", "tsconfig"), (1, "src/a.ts", "late/b"): ("src/b.ts", "tsconfig"), (1, "src/a.ts", "exact"): ("exact.json", "tsconfig"), (1, "src/a.ts", "out/x"): (None, "external"), (1, "src/a.ts", "zzz-b"): ("gen/a-b.ts", "tsconfig"),
        (1, "src/a.ts", "e/a"): (None, "external"), (1, "src/a.ts", "f/a"): (None, "external"), (1, "src/a.ts", "@me/one"): ("pkgs/one/src/index.ts", "workspace"), (1, "src/a.ts", "@me/one/util"): ("pkgs/one/util.js", "workspace"), (1, "src/a.ts", "@me/one/none"): (None, "external"), (1, "src/a.ts", "@me"): (None, "external"),
        (1, "src/a.ts", "two"): ("pkgs/two/main.mjs", "workspace"), (1, "src/a.ts", "three"): (None, "external"), (1, "src/a.ts", "dot"): (None, "external"), (1, "src/a.ts", "q"): (None, "external"), (1, "src/a.ts", "../img/logo.png"): ("img/logo.png", "asset"), (1, "src/a.ts", "./b?worker"): ("src/b.ts", "asset"),
        (1, "src/a.ts", "x.css"): (None, "asset"), (1, "src/a.ts", "/src/b"): ("src/b.ts", "root"), (1, "src/a.ts", "/gone"): (None, "unresolved"), (1, "src/a.ts", ".."): ("index.ts", "relative"), (1, "src/a.ts", "../../x"): (None, "unresolved"), (1, "src/a.ts", ""): (None, "unresolved"), (1, "src/a.ts", "node:fs"): (None, "external"),
        (2, "src/a.ts", "@ui/x"): ("lib/ui/x.js", "tsconfig"), (2, "src/a.ts", "./b"): (None, "unresolved"), (2, "src/a.ts", "@me/one"): (None, "external"), (3, "a.ts", "z"): (None, "external"),
    }
    table = spark.createDataFrame([*wanted, *list(wanted)[:3]], "repo int, importer string, specifier string")
    # as in a chain of five files: the sixth doesn't count, the fifth does
    wanted |= {(1, "src/a.ts", "e/a"): ("src/a.ts", "tsconfig")}
    got = imports.resolved(table, files, imports.path_aliases(configs), imports.workspace_packages(packages, globs)).collect()
    assert {(r["repo"], r["importer"], r["specifier"]): (r["to_path"], r["kind"]) for r in got} == wanted and len(got) == len(wanted)
    assert imports.resolved(table.limit(0), files, imports.path_aliases(configs)).count() == 0
    assert {r["kind"] for r in imports.resolved(table, files).collect()} == {"external", "relative", "root", "asset", "unresolved"}
