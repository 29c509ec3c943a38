"""Closures over more links than a recursive query takes, and over cycles."""

from pyspark.sql import functions as F

from tidemark.operators import graph


def test_closure_over_many_links(spark):
    # a tree of 1.2 million nodes, ten links each, with a link back from every node
    n = 1_200_000
    down = spark.range(1, n).select(F.floor((F.col("id") - 1) / 10).alias("a"), F.col("id").alias("b"))
    links = down.union(down.select("b", "a"))
    got = graph.closure(links, spark.range(1).select(F.col("id").alias("node")), 10).groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect()
    assert [r["n"] for r in got if r["n"]] == [1, 10, 100, 1000, 10_000, 100_000, 1_000_000, n - 1_111_111]


def test_closure_edges(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), (None, "e"), ("d", None), ("x", "y"), ("a", "b")], "a string, b string")
    start = lambda *names: spark.createDataFrame([(x,) for x in names], "node string")
    reach = lambda depth, *names: {r["node"]: r["depth"] for r in graph.closure(links, start(*names), depth).collect()}
    assert reach(9, "a") == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert reach(1, "a", "x", None) == {"a": 0, "b": 1, "c": 1, "x": 0, "y": 1}
    assert reach(0, "a") == {"a": 0} and reach(5, "z") == {"z": 0} and reach(5) == {}
