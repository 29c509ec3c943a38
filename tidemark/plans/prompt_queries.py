"""Prompts that call for a search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import prompts
from tidemark.plans.registry import query
from tidemark.sources.analogs import _pick, sql_list, table

#: What stands before the turns of conversations, so that they say all that prompts say; every third turn is this alone.
OPENINGS = [
    "fix resolveImport in ", "where is ", "how does the ", "git commit -m ", "Thanks! ", "/help ", "```\n", "what imports 'x' and ", "TypeError at run ( ", "src/a.js:12:3 ", "TODO", "sounds good.", "MAX_RETRIES ", "  ", "retrieval", "add a ", "who calls parse_log ", "hello ", "!ls ", "the and of ", "(URLSession), \"config.yaml\" ",
    "require('fs') ", "one moment", "check HTMLParser7 and lib/x.py:3 ", "show me the ", "a.b.c ",
]
PROMPTS_SQL = f"SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 4 = 3 THEN coalesce(text, '') WHEN turn % 3 = 0 THEN {sql_list(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] ELSE {sql_list(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || coalesce(text, '') END AS prompt FROM conversations"
#: Noise words: those that more than a twentieth of all turns have.
NOISE_SQL = r"SELECT word AS term FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1 HAVING count(*) > 0.05 * (SELECT count(*) FROM conversations)"


def _prompts(spark, sf_dir):
    c, t, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    opening = _pick(OPENINGS, (c + t) % len(OPENINGS))
    return table(spark, sf_dir, "conversations").select((c * 100 + t).alias("id"), F.when(c % 4 == 3, text).when(t % 3 == 0, opening).otherwise(F.concat(opening, text)).alias("prompt"))


def _noise(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))).alias("term")).filter("term <> ''")
    all_turns = turns.agg((F.count("*") * 0.05).alias("least"))
    return words.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(all_turns), F.col("n") > F.col("least")).select("term")  # one row


CLEAN = r"regexp_replace(regexp_replace(raw, '^[^a-zA-Z0-9_/.]+', ''), '[^a-zA-Z0-9_/.]+$', '')"
EXTENSIONS = r"(js|ts|jsx|tsx|mjs|cjs|mts|cts|py|pyw|swift|swiftinterface|rb|go|rs|java|kt|scala|c|cpp|cc|h|hpp|cs|fs|php|lua|ex|exs|erl|sh|bash|zsh|json|yaml|yml|toml|xml|ini|cfg|css|scss|sass|less|html|htm|vue|svelte|sql|graphql|gql|md|rst|txt|dockerfile|tf|proto)"
SHAPE = "regexp_matches(cleaned, '^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$|^[A-Z][a-zA-Z0-9]*[a-z][a-zA-Z0-9]*$|^[a-z][a-z0-9]*(_[a-z0-9]+)+$|^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$|^[A-Z]{2,}[a-z][a-zA-Z0-9]*$|^[A-Z]{2,}$')"
QUOTED = {k: getattr(prompts, k).replace("'", "''") for k in ("ACTION", "QUESTION", "DEFINITION", "IMPORT", "TRACE", "GIT", "SMALL_TALK", "FENCE")}
SAYS = {k: f"regexp_matches(said, '{v}')" for k, v in QUOTED.items()}


@query(rf"""WITH p AS (SELECT id, regexp_replace(prompt, '^\s+|\s+$', '', 'g') AS said FROM ({PROMPTS_SQL})), noise AS ({NOISE_SQL}),
r AS (SELECT id, raws[k] AS raw, k AS place FROM (SELECT id, regexp_split_to_array(said, '\s+') AS raws FROM p), unnest(range(1, len(raws) + 1)) t(k)), c AS (SELECT *, {CLEAN} AS cleaned FROM r), d AS (SELECT *, regexp_replace(cleaned, ':\d+(:\d+)?$', '') AS candidate FROM c),
s AS (SELECT *, cleaned <> '' AND (contains(candidate, '/') OR regexp_matches(candidate, '(?i)^.+\.{EXTENSIONS}$')) AS is_path FROM d), i AS (SELECT *, NOT is_path AND length(cleaned) >= 2 AND {SHAPE} AS is_id FROM s),
k AS (SELECT *, length(cleaned) >= 2 AND (is_path OR is_id OR lower(cleaned) NOT IN (SELECT term FROM noise)) AS kept FROM i),
g AS (SELECT id, count(*) AS words, count(*) FILTER (is_id) AS ids, count(*) FILTER (is_path) AS paths, coalesce((list(CASE WHEN is_path THEN candidate ELSE cleaned END ORDER BY place) FILTER (kept))[1:6], []) AS terms FROM k GROUP BY 1), b AS (SELECT *, ids = 0 AND paths = 0 AS bare, len(terms) AS n FROM g JOIN p USING (id)),
scored AS (SELECT *, (CASE WHEN ids > 0 THEN 3 ELSE 0 END + CASE WHEN paths > 0 THEN 4 ELSE 0 END + CASE WHEN {SAYS['QUESTION']} AND words >= 3 AND (NOT bare OR {SAYS['DEFINITION']} OR {SAYS['IMPORT']}) THEN 3 ELSE 0 END + CASE WHEN {SAYS['ACTION']} AND NOT bare THEN 3 ELSE 0 END + CASE WHEN {SAYS['TRACE']} THEN 2 ELSE 0 END
 + CASE WHEN {SAYS['IMPORT']} THEN 3 ELSE 0 END + CASE WHEN {SAYS['DEFINITION']} THEN 3 ELSE 0 END - CASE WHEN words < 4 AND bare AND n = 0 THEN 3 ELSE 0 END - CASE WHEN {SAYS['GIT']} AND bare THEN 4 ELSE 0 END - CASE WHEN {SAYS['SMALL_TALK']} AND bare THEN 3 ELSE 0 END - CASE WHEN words > 200 AND paths = 0 THEN 2 ELSE 0 END
 - CASE WHEN {SAYS['FENCE']} AND bare THEN 2 ELSE 0 END + CASE WHEN words <= 80 AND n > 0 THEN 1 ELSE 0 END)::BIGINT AS score, trim(regexp_replace(lower(said), '[.!?,]+$', '')) AS plain FROM b),
v AS (SELECT *, CASE WHEN said = '' OR starts_with(said, '/') OR starts_with(said, '!') OR plain IN ({', '.join(f"'{p}'" for p in prompts.PHRASES)}) OR regexp_replace(plain, ':$', '') IN ('todo', 'fixme', 'hack', 'xxx', 'note', 'wip', 'tbd') THEN 'nothing'
 WHEN words = 1 AND bare THEN CASE WHEN n = 1 AND regexp_matches(lower(terms[1]), '^[a-z][a-z0-9_-]{{2,}}$') THEN 'word' ELSE 'single' END WHEN n = 0 THEN 'termless' WHEN score >= 3 THEN 'sure' WHEN score >= 2 THEN 'doubtful' ELSE 'below' END AS way FROM scored)
SELECT id, way IN ('word', 'sure', 'doubtful') AS retrieve, CASE WHEN way IN ('nothing', 'single', 'termless') THEN []::VARCHAR[] ELSE terms END AS terms,
 round(CASE way WHEN 'nothing' THEN 1.0 WHEN 'word' THEN 0.3 WHEN 'single' THEN 0.9 WHEN 'termless' THEN 0.7 WHEN 'sure' THEN least(1.0, 0.5 + (score - 3) * 0.1) WHEN 'doubtful' THEN 0.4 ELSE greatest(0.1, 0.3 + score * 0.05) END, 6)::DOUBLE AS confidence, CASE WHEN way NOT IN ('nothing', 'word', 'single') THEN score END AS score FROM v""")
def classified_prompts(spark, sf_dir):
    """Prompts, whether they call for a search, its terms and how sure that is."""
    return prompts.classified(_prompts(spark, sf_dir), _noise(spark, sf_dir))
