"""Queries over a source tree's paths and what its files export."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths as fp
from tidemark.operators import graph
from tidemark.plans.registry import query
from tidemark.sources import analogs
from tidemark.sources.analogs import EDGES_SQL, EXPORTS_SQL, TREE_SQL, sql_list

TREE, EXPORTS, EDGES = f"tree AS ({TREE_SQL})", f"exports AS ({EXPORTS_SQL})", f"edges AS ({EDGES_SQL})"
BASE = "string_split(path, '/')[-1]"
EXT = f"lower(regexp_extract({BASE}, '^.+\\.([^.]*)$', 1))"


def _has(pattern: str, of: str = "path") -> str:
    return f"regexp_matches({of}, '{pattern}')"


TEST = "(" + " OR ".join(map(_has, [fp.TEST_FOLDER, *fp.SWIFT_TESTS, r"(?i)\.(test|spec)\.", fp.TEST_NAME])) + ")"
MERGE_TEST = "(" + " OR ".join([_has(fp.TEST_FOLDER), _has(r"\.(test|spec)\.[jt]s$", "lower(path)"), _has(fp.TEST_NAME), *map(_has, fp.SWIFT_TESTS)]) + ")"
VENDOR_SQL, DOC_SQL = _has(fp.VENDOR), f"({_has(fp.DOCS)} OR {_has(fp.DOC_NAMES, BASE)})"
TYPE_SQL = f"CASE WHEN {EXT} IN ({', '.join(repr(t) for t in fp.TYPES)}) THEN {EXT} ELSE 'other' END"
ENTRY_SQL = "((" + " OR ".join(map(_has, [fp.WEB_ENTRY, fp.PYTHON_ENTRY, *fp.SWIFT_ENTRY])) + f") AND NOT {_has(fp.SAMPLES)})"
PENALTY_SQL = f"CASE WHEN contains(lower(path), '/vendor/') OR contains(lower(path), '/node_modules/') THEN 0.5 WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') OR contains(lower(path), '/docs/') OR contains(lower(path), '/doc/') THEN 0.4 WHEN {MERGE_TEST} THEN 0.25 ELSE 0.0 END"


@query(f"WITH {TREE} SELECT {TYPE_SQL} AS type, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM tree GROUP BY 1")
def path_types(spark, sf_dir):
    return analogs.tree(spark, sf_dir).groupBy(fp.file_type(F.col("path")).alias("type")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


INDEXABLE_SQL = f"NOT starts_with(path, '.') AND NOT regexp_matches(path, '/(node_modules|\\.git|\\.planning|\\.claude|dist|build|\\.next)/') AND {EXT} IN ({', '.join(repr(t) for t in fp.CODE_TYPES)})"


@query(f"WITH {TREE} SELECT id, path FROM tree WHERE {INDEXABLE_SQL}")
def indexable_paths(spark, sf_dir):
    return analogs.tree(spark, sf_dir).filter(fp.is_indexable(F.col("path"))).select("id", "path")


@query(f"WITH {TREE} SELECT id, path FROM tree WHERE {ENTRY_SQL}")
def entry_points(spark, sf_dir):
    return analogs.tree(spark, sf_dir).filter(fp.is_entry_point(F.col("path"))).select("id", "path")


@query(f"WITH {TREE} SELECT id, {TEST} AS ranked, {MERGE_TEST} AS merged, {_has(fp.GRAPH_TESTS)} AS graph, {_has(fp.SAMPLES)} AS sample FROM tree")
def test_path_variants(spark, sf_dir):
    """Four predicates that differ: each is used by another part of retrieval."""
    p = F.col("path")
    return analogs.tree(spark, sf_dir).select("id", fp.is_test_path(p).alias("ranked"), fp.is_test_of_merge(p).alias("merged"), fp.is_test_of_graph(p).alias("graph"), fp.is_sample_path(p).alias("sample"))


@query(f"""WITH {TREE} SELECT id, {VENDOR_SQL} AS vendor, {DOC_SQL} AS doc, CASE WHEN {TEST} OR regexp_matches(path, '(?i)(^|/)(fixtures?|examples?|demos?|e2e|mocks?)/') THEN 0 WHEN {DOC_SQL} OR regexp_matches(path, '(?i)(^|/)docs?/') THEN 1 ELSE 2 END AS authority, ({PENALTY_SQL})::DOUBLE AS penalty FROM tree""")
def path_classes(spark, sf_dir):
    p = F.col("path")
    return analogs.tree(spark, sf_dir).select("id", fp.is_vendor(p).alias("vendor"), fp.is_doc(p).alias("doc"), fp.authority(p).alias("authority"), fp.merge_penalty(p).cast("double").alias("penalty"))


@query(f"""WITH {TREE}, n AS (SELECT *, lower({BASE}) AS name FROM tree) SELECT id, path FROM n WHERE list_has_any(string_split(path, '/'), ['.ssh', '.gnupg']) OR name IN ({', '.join(repr(t) for t in fp.SECRET_NAMES)})
OR {EXT} IN ({', '.join(repr(t) for t in fp.SECRET_EXTENSIONS)}) OR name = '.env' OR (starts_with(name, '.env.') AND string_split(name, '.')[-1] NOT IN ({', '.join(repr(t) for t in fp.TEMPLATES)}))""")
def sensitive_paths(spark, sf_dir):
    return analogs.tree(spark, sf_dir).filter(fp.is_sensitive(F.col("path"))).select("id", "path")


@query(f"""WITH {TREE} SELECT id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({BASE}, '\\.[^.]+$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z]+'), lambda t: lower(t)), lambda t: length(t) >= 3))) AS tokens FROM tree""")
def path_stem_tokens(spark, sf_dir):
    return analogs.tree(spark, sf_dir).select("id", F.array_sort(fp.stem_tokens(F.col("path"))).alias("tokens"))


MATCH_TERMS = ["flag", "flags", "render", "core", "index", "acme", "util", "gist"]
CLASS_SQL = """CASE WHEN own = term THEN 'stem-exact' WHEN list_contains(parts, term) THEN 'stem-token' WHEN list_contains(folders, term) THEN 'dir-segment'
  WHEN len(list_filter(parts, lambda x: (starts_with(x, term) OR ends_with(x, term)) AND length(x) - length(term) <= 2)) > 0 THEN 'near' ELSE 'loose' END"""
MATCHED = f"""m AS (SELECT id, path, term, regexp_replace(string_split(lower(path), '/')[-1], '(.)\\.[^.]*$', '\\1') AS own, string_split(lower(path), '/')[:-2] AS folders FROM tree, (SELECT unnest({sql_list(MATCH_TERMS)}) AS term) WHERE contains(lower(path), term)),
c AS (SELECT *, list_filter(regexp_split_to_array(own, '[_\\-.]+'), lambda x: x <> '') AS parts FROM m)"""


@query(f"WITH {TREE}, {MATCHED} SELECT id, term, {CLASS_SQL} AS class FROM c")
def path_match_classes(spark, sf_dir):
    terms = F.explode(F.array(*map(F.lit, MATCH_TERMS))).alias("term")
    found = analogs.tree(spark, sf_dir).select("id", "path", terms).filter(F.lower("path").contains(F.col("term")))
    return found.select("id", "term", fp.match_class(F.col("term"), F.col("path")).alias("class"))


@query(f"WITH {EXPORTS} SELECT name, kind FROM exports WHERE id = 7 ORDER BY kind, name")
def exports_of_node(spark, sf_dir):
    return graph.exports_of(analogs.exports(spark, sf_dir), 7)


@query(f"WITH {EXPORTS} SELECT term, id, name, kind FROM (SELECT t.term, e.*, row_number() OVER (PARTITION BY t.term ORDER BY kind, id, name) AS n FROM exports e JOIN (SELECT unnest(['WIDGET', 'run', 'flag_registry', 'nothing']) AS term) t ON lower(e.name) = lower(t.term)) WHERE n <= 50")
def exports_by_symbol(spark, sf_dir):
    return graph.exports_by_symbol(analogs.exports(spark, sf_dir), spark.createDataFrame([(t,) for t in ("WIDGET", "run", "flag_registry", "nothing")], "term string"), 50)


@query(f"WITH {EDGES} SELECT DISTINCT from_path FROM edges WHERE contains(lower(kind), 'lat') AND contains(specifier::VARCHAR, '7') ORDER BY 1 LIMIT 200")
def importers_by_specifier(spark, sf_dir):
    edges = analogs.edges(spark, sf_dir).filter(F.lower("kind").contains("lat"))
    return graph.importers_like(edges, "7", 200)


@query(f"WITH {EXPORTS} SELECT id, name, kind FROM exports WHERE lower(name) = 'uri' AND kind IN ('struct', 'class', 'extension') ORDER BY kind, id, name LIMIT 50")
def declarations_by_symbol(spark, sf_dir):
    declared = analogs.exports(spark, sf_dir).filter(F.col("kind").isin("struct", "class", "extension"))
    return declared.filter(F.lower("name") == "uri").orderBy("kind", "id", "name").limit(50)


@query("SELECT l_orderkey AS source, l_partkey AS target, l_returnflag AS kind, l_linestatus AS confidence FROM lineitem WHERE l_partkey = 42 AND l_returnflag = 'N' AND l_linestatus = 'O'")
def relations_by_target(spark, sf_dir):
    relations = analogs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("confidence"))
    return graph.relations_to(relations, 42, kind="N", confidence="O")


@query(f"WITH {TREE} SELECT id, path, size_bytes FROM tree ORDER BY path")
def all_file_entries(spark, sf_dir):
    return analogs.tree(spark, sf_dir).select("id", "path", "size_bytes").orderBy("path")


@query(f"WITH {TREE} SELECT o.o_orderkey AS hit, o.o_custkey AS id, t.path, coalesce(t.size_bytes, 0) AS size_bytes FROM orders o LEFT JOIN tree t ON t.id = o.o_custkey")
def file_meta_of_hits(spark, sf_dir):
    hits = analogs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hit"), F.col("o_custkey").alias("id"))
    return hits.join(analogs.tree(spark, sf_dir), "id", "left").select("hit", "id", "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))


@query(f"""WITH {EDGES}, gone AS (SELECT p_partkey AS id FROM part WHERE p_size = 7) SELECT from_path, specifier, CASE WHEN to_path IN (SELECT id FROM gone) THEN NULL ELSE to_path END AS to_path, kind FROM edges WHERE from_path NOT IN (SELECT id FROM gone)""")
def deletion_cascade(spark, sf_dir):
    gone = analogs.table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("id"))
    return graph.without_files(analogs.edges(spark, sf_dir), gone).select("from_path", "specifier", "to_path", "kind")


@query(f"WITH {TREE}, {EXPORTS}, {EDGES} SELECT (SELECT count(*) FROM tree) AS files, (SELECT count(*) FROM exports) AS exports, (SELECT count(*) FROM edges) AS edges")
def row_counts(spark, sf_dir):
    counts = [t(spark, sf_dir).agg(F.count("*").alias(n)) for n, t in (("files", analogs.tree), ("exports", analogs.exports), ("edges", analogs.edges))]
    return counts[0].join(counts[1]).join(counts[2])  # one row each


@query(f"WITH {EXPORTS} SELECT count(*) AS declarations, count(*) FILTER (kind = 'struct') AS struct, count(*) FILTER (kind = 'class') AS class, count(*) FILTER (kind = 'extension') AS extension FROM exports WHERE kind IN ('struct', 'class', 'extension')")
def declaration_counters(spark, sf_dir):
    kinds = ["struct", "class", "extension"]
    declared = analogs.exports(spark, sf_dir).filter(F.col("kind").isin(kinds))
    return declared.agg(F.count("*").alias("declarations"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


@query(f"""WITH {TREE}, s AS (SELECT string_split(path, '/')[1] AS top, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS two, {BASE} = 'index.json' AS manifest FROM tree),
d AS (SELECT top, two, count(*) AS files, bool_or(manifest) AS manifest FROM s GROUP BY 1, 2), p AS (SELECT top, count(*) FILTER (manifest) AS packages FROM d GROUP BY 1)
SELECT CASE WHEN packages >= 3 THEN two ELSE top END AS dir, sum(files)::BIGINT AS files FROM d JOIN p USING (top) GROUP BY 1""")
def expanded_dirs(spark, sf_dir):
    """Folders by their files; one with three packages or more inside is shown a level deeper."""
    return graph.expanded_dirs(analogs.tree(spark, sf_dir), fp.base_name(F.col("path")) == "index.json", 3)


@query(f"""WITH {TREE}, {EDGES}, d AS (SELECT e.to_path AS id, string_split(t.path, '/')[1] AS dir FROM edges e JOIN tree t ON t.id = e.from_path), c AS (SELECT id, dir, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, dir) AS place, count(*) OVER (PARTITION BY id) AS dirs FROM d WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT id, string_agg(dir || ' (' || n || ')', ', ' ORDER BY place) || CASE WHEN max(dirs) > 3 THEN ', …' ELSE '' END AS rollup FROM c WHERE place <= 3 GROUP BY 1""")
def dir_rollup_text(spark, sf_dir):
    tree = analogs.tree(spark, sf_dir).select(F.col("id").alias("from_path"), F.substring_index("path", "/", 1).alias("dir"))
    return graph.rollup_text(analogs.edges(spark, sf_dir).filter("to_path is not null").join(tree, "from_path").select(F.col("to_path").alias("id"), "dir"), 3)


@query("""SELECT c_custkey AS id, coalesce(list_sort(list(DISTINCT o_orderpriority)), []) AS files FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1
HAVING count(o_orderkey) = 0 OR list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '2-HIGH']) ORDER BY 1 DESC LIMIT 5""")
def rejections_for_files(spark, sf_dir):
    """Notes on any of the files, and those on none, which hold everywhere; the newest five."""
    orders = analogs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    notes = analogs.table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy(F.col("c_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("files"))
    return graph.notes_on(notes, ["1-URGENT", "2-HIGH"]).orderBy(F.desc("id")).limit(5)
