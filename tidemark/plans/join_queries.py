"""Range, as-of, suffix, set and snapshot joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import EVENTS_SQL, FILES_SQL

SPANS = """spans AS (SELECT doc_id AS key, n * 200 AS first, least(n * 200 + 199 + n * 37, n_chars) AS last FROM (SELECT doc_id, n_chars, unnest(range(1 + n_chars // 200)) AS n FROM documents)),
points AS (SELECT doc_id AS key, n AS id, n * 173 AS "at" FROM (SELECT doc_id, unnest(range(1 + n_chars // 173)) AS n FROM documents))"""


@query(f"""WITH {SPANS} SELECT key, id, "at", first, last FROM (SELECT key, id, "at", first, last, row_number() OVER (PARTITION BY key, id ORDER BY last - first, first) AS rn
FROM points JOIN spans USING (key) WHERE first <= "at" AND "at" <= last) WHERE rn = 1""")
def interval_smallest_enclosing(spark, sf_dir):
    docs = analogs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    spans = docs.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 200))))
    spans = spans.select("key", (F.col("n") * 200).alias("first"), F.least(F.col("n") * 200 + 199 + F.col("n") * 37, F.col("n_chars")).alias("last")).filter("first <= last")
    points = docs.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 173)))).select("key", "id", (F.col("id") * 173).alias("at"))
    return intervals.smallest_enclosing(points, spans, 1000)


@query(f"""WITH e AS ({EVENTS_SQL}) SELECT l.ord, l.sid, l.ts, r.turn AS surfaced FROM (SELECT * FROM e WHERE name = 'purchase') l
LEFT JOIN LATERAL (SELECT turn FROM e r WHERE r.name = 'signup' AND r.sid = l.sid AND r.ts <= l.ts ORDER BY r.ts DESC, r.turn DESC LIMIT 1) r ON true""")
def asof_latest(spark, sf_dir):
    events = analogs.events(spark, sf_dir)
    surfaced = events.filter("name = 'signup'").groupBy("sid", "ts").agg(F.max("turn").alias("surfaced"))
    return intervals.as_of(events.filter("name = 'purchase'").select("ord", "sid", "ts"), surfaced, "sid", "ts", "surfaced").select("ord", "sid", "ts", "surfaced")


@query(f"""WITH f AS ({FILES_SQL}), o AS (SELECT DISTINCT 'home/' || path AS path FROM f WHERE size_bytes % 3 = 0)
SELECT f.id, f.path FROM f WHERE EXISTS (SELECT 1 FROM o WHERE o.path = f.path OR ends_with(o.path, '/' || f.path))""")
def suffix_semi_join(spark, sf_dir):
    files = analogs.files(spark, sf_dir)
    opened = files.filter("size_bytes % 3 = 0").select(F.concat(F.lit("home/"), "path").alias("path"))
    return intervals.suffix_semi_join(files.select("id", "path"), opened).select("id", "path")


@query("""WITH w AS (SELECT DISTINCT c_nationkey AS agent, o_orderpriority || c_mktsegment AS item FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT a.agent AS a, b.agent AS b, count(*) AS overlap, list_sort(list(a.item))[1:50] AS items FROM w a JOIN w b ON a.item = b.item AND a.agent < b.agent GROUP BY 1, 2""")
def pair_overlap(spark, sf_dir):
    joined = analogs.table(spark, sf_dir, "customer").join(analogs.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    worksets = joined.select(F.col("c_nationkey").alias("agent"), F.concat("o_orderpriority", "c_mktsegment").alias("item")).distinct()
    other = worksets.select(F.col("agent").alias("b"), "item")
    pairs = worksets.withColumnRenamed("agent", "a").join(other, "item").filter("a < b").groupBy("a", "b")
    return pairs.agg(F.count("*").alias("overlap"), F.slice(F.array_sort(F.collect_list("item")), 1, 50).alias("items"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphans_anti(spark, sf_dir):
    """Opportunities that nothing has closed: customers without an urgent order."""
    orders = analogs.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    customers = analogs.table(spark, sf_dir, "customer")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("""WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS state FROM old FULL JOIN new ON old.doc_id = new.doc_id""")
def snapshot_diff(spark, sf_dir):
    """Two snapshots of documents: some files are only in one, German texts have changed."""
    docs = analogs.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    old = docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("h"))
    return intervals.snapshot_diff(old, new, "doc_id", "h")


@query("""WITH g AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')) AS was, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'F')) AS now FROM orders GROUP BY 1)
SELECT id, list_sort(list_filter(coalesce(now, []), lambda x: NOT list_contains(coalesce(was, []), x))) AS added, list_sort(list_filter(coalesce(was, []), lambda x: NOT list_contains(coalesce(now, []), x))) AS removed FROM g""")
def set_delta(spark, sf_dir):
    closed = F.col("o_orderstatus") == "F"
    sets = analogs.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.when(closed, F.col("o_orderpriority"))).alias("was"), F.collect_set(F.when(~closed, F.col("o_orderpriority"))).alias("now"))
    return sets.select("id", F.array_sort(F.array_except("now", "was")).alias("added"), F.array_sort(F.array_except("was", "now")).alias("removed"))
