"""Rendered blocks, claims, Python modules and touches derived from the driver's tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.analogs import STEPS_SQL, _pick, sql_list, steps, table

#: Blocks of surfaced rows: an order's lines.
ROWS = [
    "- `lib/a.js` — exports parseLog L12", "- `lib/b.swift` — defines Widget L44", "- `src/c.py`", "- `src/d.ts` — re-exports run", "some words of prose", "- `e.js` — path match (e)", "- `f.js` — L7: const x = 1 ",
    "- `g.swift` — declares render", "- `h.js` — export name token", "- `` — nothing", "- `i.js` — export match useState", "- `  ` — blank", "<block>",
]
BLOCKS_SQL = f"SELECT id, string_agg(row, chr(10) ORDER BY n, row) AS block FROM (SELECT l_orderkey AS id, l_linenumber AS n, {sql_list(ROWS)}[(l_orderkey * 5 + l_linenumber) % 13 + 1] AS row FROM lineitem) GROUP BY 1"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), _pick(ROWS, (F.col("l_orderkey") * 5 + F.col("l_linenumber")) % 13).alias("row"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda x: x["row"]), "\n").alias("block"))


#: Notes, spans, counts, folders, samples and times, a row for each order.
NOTES = ["lib/a.js high fan-in (12)", "no hazard here", "x<y> & \"q\" 'z' `t`", "src/b.ts high fan-in (3)"]
HOMES = ["-root-tidal", "-home-me-Tidal", "tidal", "tidalwave", "-root-tidal-x"]
SAMPLES = ['[{"kind":"changed"},{"kind":"overlap"}]', "not json", '{"kind":"changed"}', "[]", '[{"kind":"invalidated"},{"kind":"changed"},{"k":1}]', '[{"kind":"changed"},5,"changed",null,[{"kind":"changed"}]]', '[{"kind":"changed"}']
MARKS_SQL = f"""SELECT o_orderkey AS id, {sql_list(NOTES)}[o_orderkey % 4 + 1] AS note, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS first, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 + o_custkey % 2 * 9 END AS last, CASE WHEN o_orderkey % 2 > 0 THEN o_orderkey % 90 END AS line,
  (o_orderkey % 7 - 3) * 1.5::DOUBLE AS value, {sql_list(HOMES)}[o_orderkey % 5 + 1] AS folder, {sql_list(SAMPLES)}[o_custkey % 7 + 1] AS sample, o_orderkey % 400 * 4000037 AS seconds FROM orders"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("id"), _pick(NOTES, o % 4).alias("note"), F.when(o % 3 > 0, o % 50).alias("first"), F.when(o % 3 > 0, o % 50 + c % 2 * 9).alias("last"), F.when(o % 2 > 0, o % 90).alias("line"),
        ((o % 7 - 3) * 1.5).alias("value"), _pick(HOMES, o % 5).alias("folder"), _pick(SAMPLES, c % 7).alias("sample"), (o % 400 * 4000037).alias("seconds"),
    )


#: Python files, what they import, and what they define.
MODULES = ["pkg1.m2", "pkg2", "top1", "os.path", "m3", "sub1.m4", "pkg3.sub2", "top9", "pkg4.missing", "sub0"]
PY_SQL = """SELECT DISTINCT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'pkg' || (p_partkey % 7) || '/__init__.py' WHEN 1 THEN 'pkg' || (p_partkey % 7) || '/m' || (p_partkey % 11) || '.py' WHEN 2 THEN 'pkg' || (p_partkey % 7) || '/sub' || (p_partkey % 3) || '/__init__.py'
  WHEN 3 THEN 'pkg' || (p_partkey % 7) || '/sub' || (p_partkey % 3) || '/m' || (p_partkey % 11) || '.py' ELSE 'top' || (p_partkey % 4) || '.py' END AS path FROM part"""
STATEMENTS_SQL = f"""SELECT DISTINCT path AS importer, CASE WHEN l_orderkey % 3 = 0 THEN 'import' ELSE 'from' END AS statement, CASE WHEN l_orderkey % 3 = 0 OR l_suppkey % 6 > 0 THEN {sql_list(MODULES)}[l_suppkey % 10 + 1] END AS module,
  CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber % 4 END AS level FROM lineitem JOIN ({PY_SQL}) ON id = l_partkey"""
DEFINED_SQL = """SELECT p_partkey AS id, ['run', 'f' || (p_partkey % 5)] AS functions, ['Widget', 'C' || (p_partkey % 4)] AS classes, ['FLAGS', 'run'] AS constants,
  CASE WHEN p_partkey % 2 = 0 THEN ['Widget', 'run', 'FLAGS', 'elsewhere', 'f' || (p_partkey % 3)] END AS listed FROM part"""


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda n: (k % n).cast("string")
    sub = F.concat(F.lit("pkg"), of(7), F.lit("/sub"), of(3))
    path = (
        F.when(k % 5 == 0, F.concat(F.lit("pkg"), of(7), F.lit("/__init__.py"))).when(k % 5 == 1, F.concat(F.lit("pkg"), of(7), F.lit("/m"), of(11), F.lit(".py"))).when(k % 5 == 2, F.concat(sub, F.lit("/__init__.py")))
        .when(k % 5 == 3, F.concat(sub, F.lit("/m"), of(11), F.lit(".py"))).otherwise(F.concat(F.lit("top"), of(4), F.lit(".py")))
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), path.alias("path"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    plain = o % 3 == 0
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.when(plain, "import").otherwise("from").alias("statement"), F.when(plain | (s % 6 > 0), _pick(MODULES, s % 10)).alias("module"), F.when(plain, 0).otherwise(F.col("l_linenumber") % 4).cast("int").alias("level")
    )
    return lines.join(python_files(spark, sf_dir), "id").select(F.col("path").alias("importer"), "statement", "module", "level").distinct()


def defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda a, n: F.concat(F.lit(a), (k % n).cast("string"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.array(F.lit("run"), name("f", 5)).alias("functions"), F.array(F.lit("Widget"), name("C", 4)).alias("classes"), F.array(F.lit("FLAGS"), F.lit("run")).alias("constants"),
        F.when(k % 2 == 0, F.array(*map(F.lit, ["Widget", "run", "FLAGS", "elsewhere"]), name("f", 3))).alias("listed"),
    )


#: Rows served to tasks, the files and symbols of then and now.
SERVED_SQL = """SELECT DISTINCT l_suppkey AS task, 'f' || (l_partkey % 97) AS path, CASE WHEN l_linenumber % 3 > 0 THEN 'run' || (l_linenumber % 2) END AS symbol, CASE WHEN l_linenumber % 4 > 0 THEN l_partkey % 97 % 20 END AS first,
  CASE WHEN l_linenumber % 4 > 0 THEN l_partkey % 97 % 20 + 5 END AS last, CASE WHEN l_linenumber % 2 > 0 THEN l_partkey % 97 END AS line FROM lineitem"""
THEN_SQL = "SELECT DISTINCT 'f' || (p_partkey % 97) AS path, 'h' || (p_partkey % 97) AS hash FROM part WHERE p_partkey % 97 <> 5"
NOW_SQL = "SELECT DISTINCT 'f' || (p_partkey % 97) AS path, CASE WHEN p_partkey % 97 % 3 = 0 THEN 'h' || (p_partkey % 97) ELSE 'new' END AS hash, p_partkey % 97 % 7 > 0 AS stable FROM part WHERE p_partkey % 97 % 10 > 0"
SYMBOLS_SQL = "SELECT DISTINCT 'f' || (p_partkey % 97) AS path, 'run' || k AS symbol, p_partkey % 97 % 20 + k * 3 AS now_first, p_partkey % 97 % 20 + 5 + k * 3 AS now_last FROM part, (VALUES (0), (1)) v(k) WHERE p_partkey % 97 % 4 > k"


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey") % 97
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("task"), F.concat(F.lit("f"), p.cast("string")).alias("path"), F.when(n % 3 > 0, F.concat(F.lit("run"), (n % 2).cast("string"))).alias("symbol"),
        F.when(n % 4 > 0, p % 20).alias("first"), F.when(n % 4 > 0, p % 20 + 5).alias("last"), F.when(n % 2 > 0, p).alias("line"),
    ).distinct()


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files then, files now, symbols now."""
    files = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("n")).distinct().withColumns({"path": F.concat(F.lit("f"), F.col("n").cast("string")), "old": F.concat(F.lit("h"), F.col("n").cast("string"))})
    now = files.filter("n % 10 > 0").select("path", F.when(F.col("n") % 3 == 0, F.col("old")).otherwise("new").alias("hash"), (F.col("n") % 7 > 0).alias("stable"))
    symbols = files.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("n % 4 > k").select("path", F.concat(F.lit("run"), F.col("k").cast("string")).alias("symbol"), (F.col("n") % 20 + F.col("k") * 3).alias("now_first"), (F.col("n") % 20 + 5 + F.col("k") * 3).alias("now_last"))
    return files.filter("n <> 5").select("path", F.col("old").alias("hash")), now, symbols


#: What depends on the files that sessions open.
DEPENDENTS_SQL = f"SELECT DISTINCT path, replace(path, '/f0', '/f1') AS dependent FROM ({STEPS_SQL}) WHERE contains(path, '/f0') UNION SELECT path, replace(path, '/m1', '/m2') FROM ({STEPS_SQL}) WHERE contains(path, '/m1')"


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = steps(spark, sf_dir).select("path").distinct()
    other = lambda a, b: paths.filter(F.col("path").contains(a)).select("path", F.replace("path", F.lit(a), F.lit(b)).alias("dependent"))
    return other("/f0", "/f1").union(other("/m1", "/m2")).distinct()
