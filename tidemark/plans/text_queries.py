"""Line search, tiers and scalar text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import ranking
from tidemark.plans.registry import query
from tidemark.sources import analogs

LINES = "lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def _lines(spark, sf_dir):
    docs = analogs.table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select("doc_id", "lang", "line", (F.col("pos") + 1).cast("long").alias("line_no"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line, (lang <> 'en')::INTEGER AS phase FROM lines WHERE contains(lower(line), ' worthless ') ORDER BY phase, doc_id, line_no LIMIT 100")
def line_search_literal(spark, sf_dir):
    """English documents first, then the others, as source files come before the rest."""
    hits = _lines(spark, sf_dir).filter(F.lower("line").contains(" worthless "))
    return hits.select("doc_id", "line_no", "line", (F.col("lang") != "en").cast("int").alias("phase")).orderBy("phase", "doc_id", "line_no").limit(100)


#: Queries of the search tiers: phrase, then all words, then any word where there are three or more.
TERMS = [(1, "of the"), (2, "worthless clown"), (3, "idiot moron scum")]


def _tier_sql() -> str:
    parts = []
    for number, phrase in TERMS:
        words = phrase.split()
        every = " AND ".join(f"contains(lower(line), '{w}')" for w in words)
        some = " OR ".join(f"contains(lower(line), '{w}')" for w in words)
        parts.append(f"SELECT {number} AS query, doc_id, line_no, CASE WHEN contains(lower(line), '{phrase}') THEN 1 WHEN {every} THEN 2 ELSE 3 END AS tier FROM lines WHERE {some if len(words) >= 3 else every}")
    return f"WITH {LINES}, hits AS ({' UNION ALL '.join(parts)}) SELECT query, tier, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits h WHERE tier = (SELECT min(tier) FROM hits i WHERE i.query = h.query) GROUP BY 1, 2"


def tier_hits(spark, sf_dir):
    lines, low, out = _lines(spark, sf_dir), F.lower("line"), None
    for number, phrase in TERMS:
        words = phrase.split()
        n = ft.term_hits(F.col("line"), words)
        tier = F.when(low.contains(phrase), 1).when(n == len(words), 2).when((n > 0) & F.lit(len(words) >= 3), 3)
        hits = lines.select(F.lit(number).alias("query"), "doc_id", "line_no", tier.alias("tier")).filter("tier is not null")
        out = hits if out is None else out.unionByName(hits)
    return out


@query(_tier_sql())
def search_tiers(spark, sf_dir):
    """Only the strictest tier with hits counts: the least tier of each query comes from a grouped side, so a frequent query is no single task."""
    hits = tier_hits(spark, sf_dir)
    counted = hits.groupBy("query", "tier").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))
    return ranking.first_tier(counted).select("query", "tier", "hits", "docs")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line_no, length(line) AS score, list_filter(['idiot', 'moron', 'scum'], lambda t: contains(lower(line), t)) AS found FROM lines)
SELECT doc_id, (list(line_no ORDER BY len(found) DESC, score DESC, line_no))[1] AS line_no, max(len(found))::INTEGER AS coverage, len(list_distinct(flatten(list(found))))::INTEGER AS covered FROM c WHERE len(found) > 0 GROUP BY 1""")
def token_coverage_rank(spark, sf_dir):
    """Per document the line with most of the words, the best scored among equals, and how many of the words its lines hold together."""
    return ft.best_covered(_lines(spark, sf_dir).withColumn("score", F.length("line")), "doc_id", ["idiot", "moron", "scum"])


@query("""SELECT conv_id, turn, role, text, before, after FROM (SELECT *, lag(text, 1) OVER w AS one, lag(text, 2) OVER w AS two, lead(text, 1) OVER w AS next, lead(text, 2) OVER w AS last,
list_filter([lag(text, 2) OVER w, lag(text, 1) OVER w], lambda x: x IS NOT NULL) AS before, list_filter([lead(text, 1) OVER w, lead(text, 2) OVER w], lambda x: x IS NOT NULL) AS after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE contains(lower(text), ' the ') OR contains(lower(text), ' der ')""")
def hit_context(spark, sf_dir):
    """Turns that are hits of a search, with up to two whole turns before and after."""
    turns = analogs.table(spark, sf_dir, "conversations")
    found = ft.with_context(turns, "conv_id", "turn", "text", 2)
    low = F.lower("text")
    return found.filter(low.contains(" the ") | low.contains(" der ")).select("conv_id", "turn", "role", "text", "before", "after")


@query("SELECT doc_id, sha256(text) AS content, substr(sha1(source || '/' || doc_id), 1, 10) AS claim FROM documents")
def content_hashes(spark, sf_dir):
    return analogs.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"), F.substring(F.sha1(F.concat_ws("/", "source", "doc_id")), 1, 10).alias("claim"))
