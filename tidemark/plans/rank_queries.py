"""Ranking and relevance queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import statistics as st
from tidemark.operators import graph, ranking
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import EDGES_SQL

LINE_HITS = "h AS (SELECT l_partkey AS path, l_quantity AS score, l_orderkey * 10 + l_linenumber AS ord, l_suppkey % 40 AS fan_in FROM lineitem)"


def _line_hits(spark, sf_dir):
    return analogs.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_suppkey") % 40).alias("fan_in"))


@query(f"WITH {LINE_HITS} SELECT path, ord, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, ord) AS place FROM h) WHERE place <= 5")
def hits_per_file_cap(spark, sf_dir):
    return ranking.cap_per_file(_line_hits(spark, sf_dir), 5).select("path", "ord", "score", "place")


@query(f"WITH {LINE_HITS} SELECT path, max(score) AS best, count(*) AS n, max(fan_in) AS fan_in, round(max(score) * (1 + ln(1 + count(*)) * 0.075), 6) AS total FROM h GROUP BY 1 ORDER BY total DESC, fan_in DESC, n DESC, path LIMIT 50")
def file_rerank(spark, sf_dir):
    return ranking.rerank_files(_line_hits(spark, sf_dir), 50)


@query(f"""WITH edges AS ({EDGES_SQL}), seeds AS (SELECT to_path AS seed FROM (SELECT to_path, count(*) AS c FROM edges WHERE to_path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)),
r AS (SELECT DISTINCT seed, from_path AS path FROM edges JOIN seeds ON to_path = seed)
SELECT seed, path FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY path) AS n FROM r) WHERE n <= 30""")
def related_expand(spark, sf_dir):
    edges = analogs.edges(spark, sf_dir)
    seeds = F.broadcast(graph.hotspots(edges, 10).select(F.col("path").alias("seed")))  # ten rows
    related = edges.join(seeds, F.col("to_path") == F.col("seed")).select("seed", F.col("from_path").alias("path")).distinct()
    return related.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("path"))).filter("n <= 30").drop("n")


@query(f"WITH {LINE_HITS}, u AS (SELECT *, sum(score) OVER w AS used, row_number() OVER w AS place FROM h WINDOW w AS (PARTITION BY path ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING)) SELECT path, ord, used FROM u WHERE used <= 120 OR place = 1")
def budget_prefix(spark, sf_dir):
    return ranking.within_budget(_line_hits(spark, sf_dir), "path", [F.desc("score"), F.col("ord")], F.col("score"), 120).select("path", "ord", "used")


@query(f"WITH {LINE_HITS} SELECT path, ord, score FROM h ORDER BY score DESC, ord LIMIT 10")
def limit_topk(spark, sf_dir):
    return _line_hits(spark, sf_dir).select("path", "ord", "score").orderBy(F.desc("score"), "ord").limit(10)


#: Labelled documents of a source, ranked by length: quality is the gain, halved for toxic ones.
RANKED = "r AS (SELECT source AS query, CASE WHEN quality = 0 THEN 0.0 WHEN toxic = 1 THEN 0.5 ELSE 2.0 END AS gain, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id))"


def _ranked(spark, sf_dir):
    rows = analogs.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(analogs.table(spark, sf_dir, "labels"), "doc_id")
    gain = F.when(F.col("quality") == 0, 0.0).when(F.col("toxic") == 1, 0.5).otherwise(2.0)
    return rows.select(F.col("source").alias("query"), gain.alias("gain"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query(f"WITH {RANKED} SELECT query, round(sum(CASE WHEN gain >= 1 THEN 1.0 WHEN gain > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE / greatest(count(*), 1), 6) AS precision FROM r WHERE rank <= 10 GROUP BY 1")
def precision_at_k(spark, sf_dir):
    return st.precision_at(_ranked(spark, sf_dir), 10)


@query(f"WITH {RANKED} SELECT query, round(coalesce(1 / min(CASE WHEN gain >= 1 AND rank <= 10 THEN rank END), 0.0), 6) AS mrr FROM r GROUP BY 1")
def mrr_at_10(spark, sf_dir):
    return st.reciprocal_rank(_ranked(spark, sf_dir), 10)


@query(f"""WITH {RANKED}, u AS (SELECT query, gain, CASE WHEN rank % 7 <> 3 THEN rank END AS rank FROM r), i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, rank NULLS LAST) AS best FROM u),
s AS (SELECT query, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN gain / log2(best + 1) ELSE 0 END) AS ideal FROM i GROUP BY 1)
SELECT query, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg_at_k(spark, sf_dir):
    """Every seventh document wasn't ranked."""
    return st.ndcg_at(_ranked(spark, sf_dir).withColumn("rank", F.when(F.col("rank") % 7 != 3, F.col("rank"))), 10)


@query()
def permutation_lift(spark, sf_dir):
    """Files named in orders against those delivered late, with random parts as the null."""
    lines = analogs.table(spark, sf_dir, "lineitem")
    injected = lines.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("path"))
    opened = lines.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("path"))
    pool = analogs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") - 1).alias("number"))
    return st.permutation_lift(injected, opened, pool, rounds=200, seed=12345)
