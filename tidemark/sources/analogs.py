"""The driver's tables under the engine's relation names, for the registered queries.

Each relation is given twice: as a DataFrame and as the SQL that an oracle can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Import edges: an order imports parts; every eleventh part is unresolved, returned items are assets.
EDGES_SQL = """SELECT l_orderkey AS from_path, l_linenumber AS specifier,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey END AS to_path,
  CASE WHEN l_partkey % 11 = 0 THEN 'unresolved' WHEN l_returnflag = 'R' THEN 'asset' ELSE 'relative' END AS kind,
  l_returnflag = 'R' AS is_external FROM lineitem"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, missing = F.col("l_partkey"), F.col("l_partkey") % 11 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("from_path"), F.col("l_linenumber").alias("specifier"), F.when(~missing, part).alias("to_path"),
        F.when(missing, "unresolved").when(F.col("l_returnflag") == "R", "asset").otherwise("relative").alias("kind"), (F.col("l_returnflag") == "R").alias("is_external"),
    )


#: Files: parts, with a path of brand, type and key.
FILES_SQL = """SELECT p_partkey AS id, replace(p_brand, '#', '') || '/' || replace(lower(p_type), ' ', '_') || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS path,
  p_type AS type, p_size AS size_bytes, p_name AS name FROM part"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey", F.lit(".py")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_type").alias("type"), F.col("p_size").alias("size_bytes"), F.col("p_name").alias("name"))


#: Commits: an order commits suppliers' files.
COMMITS_SQL = "SELECT DISTINCT l_orderkey AS hash, l_suppkey AS file FROM lineitem"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_suppkey").alias("file"))


#: Telemetry: user as session, k of props as turn, arm by a hash bucket of the session.
EVENTS_SQL = """SELECT event_id AS ord, epoch_us(ts) // 1000 AS ts, user_id AS sid, event_type AS name, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS turn,
  CASE WHEN CAST(('0x' || substr(sha256('arm' || user_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.4 THEN 'holdback' ELSE 'armed' END AS arm FROM events"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit("arm"), "user_id"), 256), 1, 8), 16, 10).cast("long") / 4294967296
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("sid"), F.col("event_type").alias("name"), "value",
        (F.get_json_object("props", "$.k").cast("long") % 7).alias("turn"), F.when(bucket < 0.4, "holdback").otherwise("armed").alias("arm"),
    )


def _pick(values: list[str], at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: A source tree: a file for each part, with all kinds of folders, names and extensions.
FOLDERS = ["src", "lib/core", "tests", "src/__tests__", "vendor/acme", "docs", "web/node_modules/x", "Sources/XCTKit", "Sources/AppTesting", "examples", "scripts/dist", ".github", "home/.ssh"]
STEMS = ["index", "main", "app", "UserApp", "flag_registry", "test_flags", "flags_test", "CHANGELOG", "flagRegistry", "util.spec", ".env", "renderer"]
EXTENSIONS = [".js", ".ts", ".tsx", ".py", ".swift", ".md", ".json", ".mjs", ".cjs", ".jsx", ".txt", ".rst", ".pem", ".go", ".example", ".local", ""]
TREE_SQL = f"""SELECT p_partkey AS id, {sql_list(FOLDERS)}[p_partkey % 13 + 1] || '/m' || (p_partkey // 100) || '/' || {sql_list(STEMS)}[p_partkey // 13 % 12 + 1] || {sql_list(EXTENSIONS)}[p_partkey * 7 % 17 + 1] AS path, p_size AS size_bytes FROM part"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(_pick(FOLDERS, k % 13), F.lit("/m"), F.floor(k / 100).cast("string"), F.lit("/"), _pick(STEMS, F.floor(k / 13) % 12), _pick(EXTENSIONS, k * 7 % 17))
    return table(spark, sf_dir, "part").select(k.alias("id"), path.alias("path"), F.col("p_size").alias("size_bytes"))


#: What a file exports: names in several cases, some of them many files have.
NAMES = ["resolveImport", "FLAG_REGISTRY", "Widget", "session", "useState", "run", "parseGitLog", "URI", "state_of", "HTMLParser", "flags", "normalizeAll"]
KINDS = ["function", "class", "const", "explicit", "default", "struct", "extension"]
EXPORTS_SQL = f"""SELECT DISTINCT l_partkey AS id, {sql_list(NAMES)}[(l_partkey * 3 + l_linenumber) % 12 + 1] || CASE WHEN l_linenumber > 2 THEN (l_partkey % 40)::VARCHAR ELSE '' END AS name,
  {sql_list(KINDS)}[(l_partkey + l_linenumber) % 7 + 1] AS kind FROM lineitem"""


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    name = F.concat(_pick(NAMES, (k * 3 + n) % 12), F.when(n > 2, (k % 40).cast("string")).otherwise(""))
    return table(spark, sf_dir, "lineitem").select(k.alias("id"), name.alias("name"), _pick(KINDS, (k + n) % 7).alias("kind")).distinct()


#: Lines of code, a line for each line item: definitions, exports, imports, prose.
LINES = [
    "export function resolveImport(root) {", "  const flags = loadFlags()", "class Widget(Base):", "def parse_log(text):", "import { Widget } from './widget'", "module.exports = { run }", "exports.run = run", "return the value of the flags",
    "export class URI extends Node {", "FLAG_REGISTRY = {}", "public struct URI: Hashable {", "    async def run(self):", "export const useState = 1", "const x = require('./session')", "if else for while return const let", "func run() {", "extension Widget {", "export default function main() {",
    "__all__ = ['Widget', 'run']", "export { run as start, Widget }", "type State = number", "plain words about a session", "await import('./lazy')", "export * from './all'", "import 'side-effect'", "export interface Shape {", "pub fn parse_log() {", "@main", "from .models import User", "  case north", "# how to run and parse_log a Widget", '\'\'\'docs of the URI and its flags',
]
CODE_SQL = f"SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS line_no, {sql_list(LINES)}[(l_orderkey * 7 + l_linenumber) % 32 + 1] AS line, 400.0 + l_quantity AS score FROM lineitem"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (o * 10 + n).alias("line_no"), _pick(LINES, (o * 7 + n) % 32).alias("line"), (F.lit(400.0) + F.col("l_quantity")).alias("score"))


#: A telemetry log with all the names that summaries read: a row for each line item, ord its place in the log.
EVENT_NAMES = [
    "retrieval.classified", "retrieval.injected", "retrieval.empty_fallback", "retrieval.deduped", "retrieval.stale_hit", "retrieval.path_hit", "retrieval.path_miss", "retrieval.region_hit", "retrieval.region_miss", "freshness.fresh_hit",
    "freshness.stale_hit", "freshness.blackout_turn", "freshness.sync_rescan", "scan.completed", "claim.served", "contextdelta.emitted", "structure.delta", "sprawl.nudge", "coherence.report_eligible", "coherence.delta_delivered",
    "coherence.skipped", "blastradius.injected", "blastradius.path_hit", "blastradius.path_miss", "mcp.invoked", "coherence.agent_registered", "coherence.agent_returned",
]
TOOLS, OUTCOMES = ["search", "explain", "(tools/list)", "related"], ["written", "retry", "failed", "missing", "ambiguous", "withheld", "moved"]
LOG_SQL = f"""SELECT l_orderkey * 10 + l_linenumber AS ord, {sql_list(EVENT_NAMES)}[(l_orderkey * 5 + l_linenumber * 11) % 27 + 1] AS name, l_returnflag AS source, CASE l_suppkey % 5 WHEN 0 THEN 'holdback' WHEN 1 THEN 'holdback' WHEN 4 THEN NULL ELSE 'armed' END AS arm,
  l_orderkey % 500 AS turn, l_suppkey AS sid, CASE WHEN l_linestatus = 'F' THEN 'head_changed' ELSE 'sync' END AS reason, l_linenumber::BIGINT AS n, l_quantity % 4 AS changed, CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok,
  {sql_list(TOOLS)}[l_partkey % 4 + 1] AS tool, CASE WHEN l_suppkey % 3 > 0 THEN 'client' || (l_suppkey % 3) END AS client, l_extendedprice AS duration_ms, l_tax > 0.02 AS success, l_discount > 0.03 AS retrieve,
  {sql_list(OUTCOMES)}[l_partkey % 7 + 1] AS outcome, CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 50 END AS agent FROM lineitem"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        (o * 10 + n).alias("ord"), _pick(EVENT_NAMES, (o * 5 + n * 11) % 27).alias("name"), F.col("l_returnflag").alias("source"), F.when(s % 5 <= 1, "holdback").when(s % 5 < 4, "armed").alias("arm"), (o % 500).alias("turn"), s.alias("sid"),
        F.when(F.col("l_linestatus") == "F", "head_changed").otherwise("sync").alias("reason"), n.cast("long").alias("n"), (F.col("l_quantity") % 4).alias("changed"), F.when(p % 3 == 0, True).when(p % 3 == 1, False).alias("ok"),
        _pick(TOOLS, p % 4).alias("tool"), F.when(s % 3 > 0, F.concat(F.lit("client"), (s % 3).cast("string"))).alias("client"), F.col("l_extendedprice").alias("duration_ms"), (F.col("l_tax") > 0.02).alias("success"), (F.col("l_discount") > 0.03).alias("retrieve"),
        _pick(OUTCOMES, p % 7).alias("outcome"), F.when(p % 9 > 0, p % 50).alias("agent"),
    )


#: Sessions of twenty orders: every third order surfaces the parts of its lines, the others open them, some by their absolute path.
SOURCES = ["exported_symbol", "text_only", "path_match"]
STEPS_SQL = f"""SELECT l_orderkey // 20 AS sid, l_orderkey * 10 + CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber END AS ord, CASE WHEN l_orderkey % 3 = 0 THEN 'inject' ELSE 'open' END AS kind, l_linenumber AS slot,
  CASE WHEN l_orderkey % 3 > 0 AND l_linenumber = 2 THEN '/repo/' ELSE '' END || CASE WHEN min(l_partkey) % 9 = 0 THEN 'tests' ELSE 'src' END || '/m' || (min(l_partkey) % 4) || '/f' || (min(l_suppkey) % 3) || '.js' AS path,
  CASE WHEN l_orderkey % 2 = 0 THEN 'retrieval' ELSE 'static' END AS mode, {sql_list(SOURCES)}[(l_linenumber + l_orderkey) % 3 + 1] AS source, CASE WHEN min(l_partkey) % 3 = 0 THEN 'Edit' ELSE 'Read' END AS tool FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    surfaced = o % 3 == 0
    path = F.concat(F.when(~surfaced & (n == 2), "/repo/").otherwise(""), F.when(F.col("p") % 9 == 0, "tests").otherwise("src"), F.lit("/m"), (F.col("p") % 4).cast("string"), F.lit("/f"), (F.col("s") % 3).cast("string"), F.lit(".js"))
    return rows.select(
        F.floor(o / 20).alias("sid"), (o * 10 + F.when(surfaced, 0).otherwise(n)).alias("ord"), F.when(surfaced, "inject").otherwise("open").alias("kind"), n.alias("slot"), path.alias("path"),
        F.when(o % 2 == 0, "retrieval").otherwise("static").alias("mode"), _pick(SOURCES, (n + o) % 3).alias("source"), F.when(F.col("p") % 3 == 0, "Edit").otherwise("Read").alias("tool"),
    )


#: Whole sources: the lines of code of each file together.
SOURCE_SQL = f"SELECT id, string_agg(line, chr(10) ORDER BY line_no, line) AS source FROM ({CODE_SQL}) GROUP BY 1"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return code(spark, sf_dir).groupBy("id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("source"))


#: What files of the tree import.
SPECIFIERS = [
    "./index", "./main.js", "../m0/app", "react", "node:fs", "./UserApp.js", "../../src/m0/index", "./flag_registry", "./", "../m0", "./util.spec", "../../../../out", "./renderer.mjs", "./UserApp", "/src/m0/index", "/lib/core/m1/main.js",
    "./logo.png", "./index.js?raw", "theme.css", "~0/index", "~1/UserApp", "~4/renderer", "~8/app", "@app2", "@acme/m1", "@acme/m2/renderer", "pkg3", "pkg6/main.js", "@acme", "#x/y", "",
]
IMPORTS_SQL = f"SELECT DISTINCT path AS importer, {sql_list(SPECIFIERS)}[(l_partkey + l_linenumber * 3) % {len(SPECIFIERS)} + 1] AS specifier FROM lineitem JOIN ({TREE_SQL}) t ON t.id = l_partkey"


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), _pick(SPECIFIERS, (F.col("l_partkey") + F.col("l_linenumber") * 3) % len(SPECIFIERS)).alias("specifier")).distinct()
    return lines.join(tree(spark, sf_dir), "id").select(F.col("path").alias("importer"), "specifier").distinct()


#: Configuration files, one for each region, each of which extends the next; nations are patterns, some of which a file overrides.
CONFIG_SQL = """SELECT r_regionkey AS level, ['tsconfig.json', 'conf/c1.json', 'conf/c2.json', 'conf/c3.json', 'conf/c4.json'][r_regionkey + 1] AS path, ['./conf/c1', './c2.json', './c3', './c4', NULL][r_regionkey + 1] AS extends, CASE r_regionkey WHEN 1 THEN 'src' WHEN 3 THEN 'web' END AS base_url,
 list_transform(list(n_nationkey ORDER BY n_nationkey), lambda n: {'pattern': CASE WHEN n % 6 = 5 THEN '@app' || (n % 3) ELSE '~' || (n // 2 % 9) || '/*' END, 'targets': CASE WHEN n % 6 = 5 THEN ['m0/index', '../docs/m0/main.ts'] ELSE ['m' || (n % 3) || '/*', '../lib/core/m' || (n % 4) || '/*', '/out/*'] END}) AS paths FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"""


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = F.col("r_regionkey"), F.col("n")
    text = lambda c: c.cast("string")

    def mapped(n):
        exact = n % 6 == 5
        pattern = F.when(exact, F.concat(F.lit("@app"), text(n % 3))).otherwise(F.concat(F.lit("~"), text(F.floor(n / 2) % 9), F.lit("/*")))
        targets = F.when(exact, F.array(F.lit("m0/index"), F.lit("../docs/m0/main.ts"))).otherwise(F.array(F.concat(F.lit("m"), text(n % 3), F.lit("/*")), F.concat(F.lit("../lib/core/m"), text(n % 4), F.lit("/*")), F.lit("/out/*")))
        return F.struct(pattern.alias("pattern"), targets.alias("targets"))

    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("n"))
    base = F.when(r == 1, "src").when(r == 3, "web")
    extends = F.element_at(F.array(*map(F.lit, ["./conf/c1", "./c2.json", "./c3", "./c4"]), F.lit(None).cast("string")), (r + 1).cast("int"))
    path = _pick(["tsconfig.json", "conf/c1.json", "conf/c2.json", "conf/c3.json", "conf/c4.json"], r)
    return table(spark, sf_dir, "region").join(nations, "r_regionkey").select(F.lit(0).alias("repo"), path.alias("path"), extends.alias("extends"), base.alias("base_url"), F.transform(n, mapped).alias("paths"))


#: Packages of the tree's folders: some names twice, some folders that no workspace takes in.
PACKAGES_SQL = """SELECT DISTINCT CASE p_partkey % 13 WHEN 0 THEN 'src/m' WHEN 1 THEN 'lib/core/m' WHEN 4 THEN 'vendor/acme/m' WHEN 6 THEN 'web/node_modules/x/m' ELSE '.github/m' END || (p_partkey // 100) AS dir,
 CASE WHEN p_partkey // 100 % 3 > 0 THEN '@acme/m' || (p_partkey // 100 % 7) ELSE 'pkg' || (p_partkey // 100) END AS name, CASE WHEN p_partkey // 100 % 4 = 0 THEN './renderer.mjs' END AS module, CASE WHEN p_partkey // 100 % 2 = 0 THEN 'main.js' END AS main, NULL::VARCHAR AS types FROM part WHERE p_partkey % 13 IN (0, 1, 4, 6, 11)"""
WORKSPACES = ["lib/core/*", "./src/**/", "web/**", ".github/*"]


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("p_partkey"), F.floor(F.col("p_partkey") / 100)
    text = lambda c: c.cast("string")
    folder = F.when(k % 13 == 0, "src/m").when(k % 13 == 1, "lib/core/m").when(k % 13 == 4, "vendor/acme/m").when(k % 13 == 6, "web/node_modules/x/m").otherwise(".github/m")
    name = F.when(m % 3 > 0, F.concat(F.lit("@acme/m"), text(m % 7))).otherwise(F.concat(F.lit("pkg"), text(m)))
    rows = table(spark, sf_dir, "part").filter(k.isNotNull() & (k % 13).isin(0, 1, 4, 6, 11))
    return rows.select(F.lit(0).alias("repo"), F.concat(folder, text(m)).alias("dir"), name.alias("name"), F.when(m % 4 == 0, "./renderer.mjs").alias("module"), F.when(m % 2 == 0, "main.js").alias("main"), F.lit(None).cast("string").alias("types")).distinct()


#: Evaluated cases, one for each order: metrics with and without the graph, and what usefulness is made of.
CASES_SQL = """SELECT o_orderkey AS id, o_custkey % 11 = 0 AS negative, o_orderkey % 6 > 0 AS pass, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 / 4.0 END AS p_on, o_custkey % 3 / 4.0 AS p_off, o_orderkey % 8 / 8.0 AS mrr, o_custkey % 16 / 16.0 AS n_on, o_orderkey % 16 / 16.0 AS n_off,
  CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 14 END AS primary_rank, o_custkey % 2 = 0 AS good_hits, o_orderkey % 4 AS warnings, o_custkey % 5 = 0 AS exact, o_orderkey % 9 > 0 AS graph, o_orderkey % 3 AS related, o_custkey % 4 AS lib_related, o_orderkey % 13 AS ranked FROM orders"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("id"), (c % 11 == 0).alias("negative"), (o % 6 > 0).alias("pass"), F.when(o % 5 > 0, c % 4 / 4).alias("p_on"), (c % 3 / 4).alias("p_off"), (o % 8 / 8).alias("mrr"), (c % 16 / 16).alias("n_on"), (o % 16 / 16).alias("n_off"),
        F.when(o % 7 > 0, c % 14).alias("primary_rank"), (c % 2 == 0).alias("good_hits"), (o % 4).alias("warnings"), (c % 5 == 0).alias("exact"), (o % 9 > 0).alias("graph"), (o % 3).alias("related"), (c % 4).alias("lib_related"), (o % 13).alias("ranked"),
    )
