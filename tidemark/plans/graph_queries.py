"""Queries over the import graph, files and co-changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import name_tokens, top_segment
from tidemark.operators import graph
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import COMMITS_SQL, EDGES_SQL, FILES_SQL

EDGES, FILES, COMMITS = f"edges AS ({EDGES_SQL})", f"files AS ({FILES_SQL})", f"commits AS ({COMMITS_SQL})"


@query(f"WITH {EDGES} SELECT to_path AS path, count(*) AS c FROM edges WHERE to_path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def hotspots_fan_in(spark, sf_dir):
    return graph.hotspots(analogs.edges(spark, sf_dir), 10)


@query(f"WITH {EDGES} SELECT specifier, to_path, kind, is_external FROM edges WHERE from_path = 7 ORDER BY specifier")
def edges_of_node(spark, sf_dir):
    return graph.outgoing(analogs.edges(spark, sf_dir), 7).select("specifier", "to_path", "kind", "is_external").orderBy("specifier")


@query(f"WITH {EDGES} SELECT from_path, specifier FROM edges WHERE to_path = 42")
def dependents_of_node(spark, sf_dir):
    return graph.incoming(analogs.edges(spark, sf_dir), 42).select("from_path", "specifier").orderBy("from_path", "specifier")


@query(f"WITH {EDGES} SELECT DISTINCT from_path FROM edges WHERE kind = 'unresolved' ORDER BY 1 LIMIT 500")
def unresolved_sources(spark, sf_dir):
    return graph.unresolved_sources(analogs.edges(spark, sf_dir), 500)


@query(f"WITH {EDGES} (SELECT DISTINCT 'imports' AS relation, to_path AS path FROM edges WHERE from_path = 7 AND to_path IS NOT NULL ORDER BY 2 LIMIT 15) UNION ALL (SELECT DISTINCT 'imported_by', from_path FROM edges WHERE to_path = 7 ORDER BY 2 LIMIT 15)")
def neighbors_1hop(spark, sf_dir):
    return graph.neighbours(analogs.edges(spark, sf_dir), 7, 15)


@query(f"""WITH {EDGES}, {FILES}, i AS (SELECT to_path AS id, count(*) AS n FROM edges WHERE NOT is_external GROUP BY 1), o AS (SELECT from_path AS id, count(*) AS n FROM edges WHERE NOT is_external GROUP BY 1)
SELECT id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM files LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def fan_in_out(spark, sf_dir):
    return graph.fan_in_out(analogs.files(spark, sf_dir).select("id"), analogs.edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT count(*) AS total, count(*) FILTER (kind <> 'unresolved') AS resolved, round(100.0 * count(*) FILTER (kind <> 'unresolved') / count(*)) AS pct FROM edges WHERE NOT is_external")
def resolution_stats(spark, sf_dir):
    return graph.resolution_stats(analogs.edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT specifier, count(*) AS n FROM edges WHERE kind = 'unresolved' AND NOT is_external GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_misses(spark, sf_dir):
    return graph.top_misses(analogs.edges(spark, sf_dir), "specifier", 8)


@query(f"WITH {FILES} SELECT coalesce(type, 'other') AS type, count(*) AS n FROM files GROUP BY 1")
def type_counts(spark, sf_dir):
    return graph.type_counts(analogs.files(spark, sf_dir))


@query(f"WITH {FILES} SELECT id, path FROM files WHERE contains(lower(path), 'brand#1') OR contains(lower(path), '_1') ORDER BY id LIMIT 20")
def path_substring_match(spark, sf_dir):
    path = F.lower("path")
    return analogs.files(spark, sf_dir).filter(path.contains("brand#1") | path.contains("_1")).select("id", "path").orderBy("id").limit(20)


@query(f"WITH {FILES} SELECT id, path FROM files WHERE starts_with(lower(path), 'brand1')")
def prefix_scan(spark, sf_dir):
    return analogs.files(spark, sf_dir).filter(F.lower("path").startswith("brand1")).select("id", "path")


@query(f"WITH {FILES} SELECT id, name, type FROM files WHERE lower(name) = (SELECT lower(max(name)) FROM files)")
def symbol_lookup_ci(spark, sf_dir):
    files = analogs.files(spark, sf_dir)
    wanted = files.agg(F.lower(F.max("name")).alias("wanted"))
    return files.join(F.broadcast(wanted), F.lower("name") == F.col("wanted")).select("id", "name", "type")  # one row


TOKENS = """tokens AS (SELECT id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(name), '[-_.$ ]+'), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3))) AS token FROM files)"""


def _tokens(spark, sf_dir):
    return analogs.files(spark, sf_dir).select("id", F.explode(name_tokens(F.col("name"))).alias("token"))


@query(f"WITH {FILES}, {TOKENS} SELECT id, token FROM tokens")
def name_tokens_of_files(spark, sf_dir):
    return _tokens(spark, sf_dir)


@query(f"WITH {FILES}, {TOKENS} SELECT token, count(DISTINCT id) AS df FROM tokens GROUP BY 1")
def doc_frequency(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("token").agg(F.countDistinct("id").alias("df"))


CAP = "cap AS (SELECT greatest(3, list_sort(list(df))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1]) AS cap FROM (SELECT token, count(DISTINCT id) AS df FROM tokens GROUP BY 1))"


def _cap(tokens):
    """The frequency at place floor((n - 1) * 0.95) of the sorted ones, three at least: from counts of equal frequencies."""
    df = tokens.groupBy("token").agg(F.countDistinct("id").alias("df")).groupBy("df").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.orderBy("df")  # a row for each distinct frequency
    placed = df.select("df", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    return placed.filter(F.col("upto") > F.floor((F.col("all") - 1) * 0.95)).agg(F.greatest(F.lit(3).cast("long"), F.min("df")).alias("cap"))


@query(f"WITH {FILES}, {TOKENS}, {CAP} SELECT cap FROM cap")
def df_cap_p95(spark, sf_dir):
    return _cap(_tokens(spark, sf_dir))


@query(f"""WITH {FILES}, {TOKENS}, {CAP}, rare AS (SELECT token, count(DISTINCT id) AS df FROM tokens GROUP BY 1 HAVING count(DISTINCT id) <= (SELECT cap FROM cap))
SELECT token, id, df FROM tokens JOIN rare USING (token)""")
def inverted_index_lookup(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    rare = tokens.groupBy("token").agg(F.countDistinct("id").alias("df")).join(F.broadcast(_cap(tokens)), F.col("df") <= F.col("cap"))  # one row
    return tokens.join(rare.select("token", "df"), "token").select("token", "id", "df")


@query(f"""WITH {FILES}, c AS (SELECT split_part(path, '/', 1) AS dir, type, count(*) AS n FROM files GROUP BY 1, 2)
SELECT dir, sum(n)::BIGINT AS files, (list(type ORDER BY n DESC, type))[1] AS dominant FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7""")
def dir_rollup_mode(spark, sf_dir):
    return graph.dominant_type(analogs.files(spark, sf_dir), top_segment(F.col("path")), 7)


FLOWS = "flows AS (SELECT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def _flows(spark, sf_dir):
    t = lambda n: analogs.table(spark, sf_dir, n)
    rows = t("lineitem").select("l_suppkey", "l_orderkey").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))


@query(f"""WITH {FLOWS}, c AS (SELECT a, b, count(*) AS n FROM flows WHERE a <> b GROUP BY 1, 2),
p AS (SELECT least(a, b) AS low, greatest(a, b) AS high, sum(n)::BIGINT AS mass, max(n) AS most, (list(a ORDER BY n DESC, a DESC))[1] AS leads FROM c GROUP BY 1, 2)
SELECT low, high, mass, leads, round((2 * most - mass) / mass, 6) AS asymmetry FROM p WHERE (2 * most - mass) / mass >= 0.2""")
def flow_asymmetry(spark, sf_dir):
    return graph.flow_asymmetry(_flows(spark, sf_dir), 0.2)


@query(f"WITH {FLOWS} SELECT count(*) FILTER (a = 3 AND b = 3) AS internal, count(*) FILTER (a <> 3 AND b = 3) AS inbound, count(*) FILTER (a = 3 AND b <> 3) AS outbound FROM flows")
def explain_group(spark, sf_dir):
    return graph.explain_group(_flows(spark, sf_dir), F.col("a"), F.col("b"), 3)


PAIRS = f"""WITH {COMMITS}, sized AS (SELECT hash FROM (SELECT hash, count(DISTINCT file) AS n FROM commits GROUP BY 1) WHERE n <= 5),
kept AS (SELECT c.hash, c.file FROM commits c JOIN sized USING (hash)), occ AS (SELECT file, count(*) AS n FROM kept GROUP BY 1),
p AS (SELECT x.file AS file_a, y.file AS file_b, count(*) AS count FROM kept x JOIN kept y ON x.hash = y.hash AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 3),
pairs AS (SELECT file_a, file_b, count, round(count / least(a.n, b.n), 6) AS confidence FROM p JOIN occ a ON a.file = file_a JOIN occ b ON b.file = file_b ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 5000),
degree AS (SELECT path, count(*) AS degree FROM (SELECT file_a AS path FROM pairs UNION ALL SELECT file_b FROM pairs) GROUP BY 1)"""


def _pairs(spark, sf_dir):
    return graph.cochange_pairs(analogs.commits(spark, sf_dir), bulk=5, min_count=3, limit=5000)


@query(f"{PAIRS} SELECT file_a, file_b, count, confidence FROM pairs")
def cochange_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"{PAIRS} SELECT path, degree FROM degree")
def cochange_degree(spark, sf_dir):
    return graph.partner_degree(_pairs(spark, sf_dir))


@query(f"""{PAIRS}, own AS (SELECT CASE WHEN file_a = 5 THEN file_b ELSE file_a END AS path, count, confidence FROM pairs WHERE file_a = 5 OR file_b = 5)
SELECT path, count, confidence FROM own LEFT JOIN degree USING (path) WHERE coalesce(degree, 0) <= 98 ORDER BY confidence DESC, count DESC, path LIMIT 8""")
def cochange_partners_damped(spark, sf_dir):
    return graph.partners(_pairs(spark, sf_dir), 5, hub_degree=98, limit=8)


LINKS = "links AS (SELECT DISTINCT l_suppkey AS a, l_suppkey * 7 % (SELECT max(s_suppkey) + 1 FROM supplier) AS b FROM lineitem UNION SELECT DISTINCT l_suppkey, l_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) FROM lineitem)"


@query(f"""WITH RECURSIVE {LINKS}, walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT b, depth + 1 FROM walk JOIN links ON a = node WHERE depth < 5)
SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1""")
def recursive_chain(spark, sf_dir):
    lines = analogs.table(spark, sf_dir, "lineitem")
    size = F.broadcast(analogs.table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("size")))  # one row
    first = lines.select("l_suppkey").distinct().join(size).select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") * 7 % F.col("size")).alias("b"))
    more = lines.select("l_suppkey", "l_partkey").join(size).select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % F.col("size")).alias("b"))
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.closure(first.union(more), start, 5)


@query("""SELECT c_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS files FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1
HAVING list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '2-HIGH'])""")
def array_overlap_filter(spark, sf_dir):
    joined = analogs.table(spark, sf_dir, "customer").join(analogs.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    grouped = joined.groupBy(F.col("c_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("files"))
    return grouped.filter(F.arrays_overlap("files", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))
