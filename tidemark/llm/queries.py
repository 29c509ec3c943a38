"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import infill, jaccard, media, mixing, negatives, packing, quality, suffixes, token_files, toxicity, url_rules, vectors, warc
from tidemark.llm.common import new_path


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as compressed planes and read back: where they start, how many, and their checksum."""
    path = new_path(spark, "token-blocks")
    token_files.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_files.read_documents(spark, path)


def op2_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links with cosine 0.95 or more and the component they make."""
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as samples of a media format, read back and described."""
    path = new_path(spark, "media")
    media.store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return media.read_stored(spark, path)


def op4_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out fold."""
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each source gives to a mix whose smaller sources come twice at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix.*")


OP5_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(source, '') AS key, coalesce(doc_id::VARCHAR, '') AS id,
         ceil(strlen(coalesce(text, '')) / {mixing.TOKEN_BYTES}.0)::BIGINT AS tokens
  FROM documents
), totals AS (
  SELECT key, sum(tokens)::BIGINT AS total, ceil(count(*) / {mixing.BLOCK_DOCUMENTS}.0)::BIGINT AS blocks
  FROM sizes GROUP BY key HAVING sum(tokens) > 0
), most AS (
  SELECT max(total) AS most, min(total) AS least FROM totals
), bisect(low, high) AS (
  SELECT 0::BIGINT, {mixing.GRID}::BIGINT
  UNION ALL
  SELECT CASE WHEN met THEN low ELSE mid + 1 END, CASE WHEN met THEN mid ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS mid, pow(least / most, ((low + high) // 2) / {mixing.GRID}.0 - 1) <= {mixing.MAX_REPEATS} AS met
        FROM bisect, most WHERE low < high)
), quotas AS (
  SELECT key, total, blocks, floor(most * pow(total / most, a))::BIGINT AS quota
  FROM totals, most, (SELECT max(low) / {mixing.GRID}.0 AS a FROM bisect)
), placed AS (
  SELECT doc_id, source, key, id, tokens, quota, total, quota // total AS epochs,
         ('0x' || substr(md5('{mixing.SEED}/' || key || '/' || id), 1, 12))::BIGINT % blocks AS block
  FROM sizes JOIN quotas USING (key)
), sized AS (
  SELECT key, block, quota, total, epochs, sum(tokens)::BIGINT AS size FROM placed GROUP BY ALL
), passed AS (
  SELECT *, (sum(size) OVER (PARTITION BY key, epoch ORDER BY md5('{mixing.SEED}/' || key || '/' || epoch || '/' || block), block) - size)::BIGINT AS ahead
  FROM (SELECT *, unnest(range(epochs + 1)) AS epoch FROM sized)
), taken AS (
  SELECT key, block, epoch, epoch * total + ahead AS before, size,
         CASE WHEN epoch < epochs THEN total ELSE quota - epochs * total END - ahead AS rest
  FROM passed
)
SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, block, before, quota FROM (
  SELECT p.doc_id, p.source, p.tokens, t.epoch, p.block, t.before, p.quota, t.rest, t.size,
         sum(p.tokens) OVER (PARTITION BY p.key, p.block, t.epoch ORDER BY md5('{mixing.SEED}/' || p.key || '/' || t.epoch || '/' || p.id), p.id) AS until
  FROM placed p JOIN taken t USING (key, block) WHERE t.rest > 0
) WHERE rest >= size OR until <= rest
"""


def op6_prefix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles, links and component."""
    return jaccard.similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back by its chain of records."""
    path = new_path(spark, "archives")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archives(spark, path)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1,024 tokens."""
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels outside the held-out fold."""
    return quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 200 bytes and more that occur elsewhere."""
    out = suffixes.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_displacement_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut and reordered for infilling; digests of the outputs and of the texts restored from them."""
    cut = infill.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hashed = cut.select("*", F.sha2("output", 256).alias("output_sha256"), F.col("form").alias("kind"))
    back = infill.restore(hashed)
    return back.select("doc_id", "n", F.col("kind").alias("form"), "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(tokens) AS n, [('0x' || substr(digest, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM cut
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(tokens[1:low], '') AS prefix, array_to_string(tokens[low + 1:high], '') AS middle, array_to_string(tokens[high + 1:], '') AS suffix FROM formed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

#: The rules of op12: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_interval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the longest of four rules."""
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r))) for r in URL_RULES))))
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP12_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}
), parts AS (
  SELECT page_id, row_number() OVER () AS row, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, row, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), urls AS (
  SELECT page_id, row, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM urls LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
"""


def op13_packed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh vector's label moved on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))


OP13_SQL = """
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS row, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_rotation_codes": op2_rotation_codes,
    "op3_signature_sniffing": op3_signature_sniffing,
    "op4_toxic_sentences": op4_toxic_sentences,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_prefix_orders": op6_prefix_orders,
    "op7_warc_chain": op7_warc_chain,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_kernel_quality": op9_kernel_quality,
    "op10_bucket_refinement": op10_bucket_refinement,
    "op11_displacement_scatter": op11_displacement_scatter,
    "op12_interval_sweep": op12_interval_sweep,
    "op13_packed_products": op13_packed_products,
}
ORACLE_SQL: dict[str, str] = {"op5_temperature_mixing": OP5_SQL, "op11_displacement_scatter": OP11_SQL, "op12_interval_sweep": OP12_SQL, "op13_packed_products": OP13_SQL}
