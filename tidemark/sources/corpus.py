"""A corpus of files with lines of text: the documents under paths of all kinds, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.analogs import _pick, sql_list, table

FOLDERS = ["", "lib/", "node_modules/", "docs/", "src/.cache/", "dist/", "src/dist/", ".planning/"]
ENDINGS = [".py", ".md", ".ts", ".txt", ".swift", ""]
LINES_SQL = f"""SELECT path, n::BIGINT AS line_no, found[n] AS line FROM (SELECT {sql_list(FOLDERS)}[doc_id % 8 + 1] || source || '/d' || doc_id || {sql_list(ENDINGS)}[doc_id // 8 % 6 + 1] AS path, string_split(text, chr(10)) AS found FROM documents),
unnest(range(1, len(found) + 1)) t(n)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(_pick(FOLDERS, k % 8), "source", F.lit("/d"), k.cast("string"), _pick(ENDINGS, F.floor(k / 8) % 6))
    split = table(spark, sf_dir, "documents").select(path.alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")

#: Code of parts: Python files with lines at any depth, and braced ones.
PYTHON_LINES = ["class A:", "def f(x):", "x = 1", "", "# note", "async def g():", "return x", "s = 'def no():'"]
BRACED_LINES = ["class A {", "function f(x) {", "}", "x = 1;", "if (x) {", "} else {", "const g = (y) => {", "m(a) {", "", "}", "s = 'x }'"]
CODE_SQL = f"""SELECT CASE WHEN l_partkey % 2 = 0 THEN 'p' || l_partkey || '.py' ELSE 'b' || l_partkey || '.ts' END AS path, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS line_no,
 CASE WHEN l_partkey % 2 = 0 THEN repeat('    ', (l_orderkey + l_linenumber) % 4) || {sql_list(PYTHON_LINES)}[(l_orderkey * 5 + l_linenumber * 3) % 8 + 1] ELSE {sql_list(BRACED_LINES)}[(l_orderkey * 5 + l_linenumber * 3) % 11 + 1] END AS line FROM lineitem"""


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, p = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    python = p % 2 == 0
    path = F.when(python, F.concat(F.lit("p"), p.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("b"), p.cast("string"), F.lit(".ts")))
    line = F.when(python, F.concat(F.repeat(F.lit("    "), ((o + n) % 4).cast("int")), _pick(PYTHON_LINES, (o * 5 + n * 3) % 8))).otherwise(_pick(BRACED_LINES, (o * 5 + n * 3) % 11))
    number = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")).cast("long")
    return table(spark, sf_dir, "lineitem").select(path.alias("path"), number.alias("line_no"), line.alias("line"))
