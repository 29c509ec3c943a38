"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and gets the last one's result as docs; all but
the last return the columns of documents. run() writes each stage's result to the
shared folder and reads it back. A stage deletes what the stages before it have written
on their way, unless docs still reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, quality, suffixes
from tidemark.llm.common import release, scratch, stash

#: No SQL expresses the classifier; tests compare the stages with plain versions.
ORACLE_SQL = None


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col("doc_id").alias("wanted_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted_id"]), "left_semi")


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        with scratch():
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows that repeat an id go only if all are rejected."""
    scored = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _with_ids(docs, scored.filter("predicted = 1"))


@_stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of similar word shingles join, one with the smallest id stays, a null id being the largest; rows without words all stay.

    A row is named by a hash of its id and text, so rows that repeat an id, or have none,
    are documents of their own; rows with equal names are copies.
    """
    name = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.withColumn("row_name", name)
    found = stash(jaccard.similar_sets(rows.select("row_name", "text"), id_col="row_name"), "jaccard-classes").withColumnRenamed("doc_id", "row_name")
    ids = rows.select("row_name", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_name")
    named = found.filter("n_shingles > 0").groupBy("row_name", "component_id").agg(F.count("*").alias("copies")).join(ids, "row_name")
    chosen = stash(named.groupBy("component_id").agg(F.min_by(F.struct("row_name", "copies"), order).alias("row")).select("row.*"), "jaccard-kept")
    wordless = found.filter("n_shingles = 0").select("row_name").distinct()
    single = rows.join(chosen.filter("copies = 1").select("row_name").union(wordless), "row_name", "left_semi")
    # Copies of a kept row's id and text: one of them stays.
    copied = rows.join(chosen.filter("copies > 1"), "row_name", "left_semi").dropDuplicates(["row_name"])
    return single.unionByName(copied).select(*docs.columns)


@_stage
def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out of the texts, whole characters only; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = suffixes.remove_repeats(docs, carry=others, as_text=True)
    now = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(now.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought towards even weights: the largest comes once, no other more often than twice."""
    taken = "mix" + "_" * max(map(len, docs.columns))  # a name that no column has
    return mixing.mix(docs, out_col=taken).drop(taken)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents and 1,024-token pieces of longer ones, placed in as few sequences as best-fit decreasing finds; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", suffix_array),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
