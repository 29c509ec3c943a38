"""Retrieval over the graph of a source tree: layers of evidence for a prompt's terms, their ranking, and what they add to text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import code as fc
from tidemark.functions import paths as fp
from tidemark.functions.text import holding, name_tokens
from tidemark.operators.ranking import fan_in_fraction
from tidemark.sources.shared import written

#: Scores of the kinds of evidence, and the fan-in from which a plain word counts.
SYMBOL, DECLARED, CHAIN, TOKEN, STRONG_PATH, PATH, PLAIN_FAN_IN = 100, 80, 80, 85, 70, 60, 5
#: Kinds of declarations that name a type.
TYPE_KINDS = ["struct", "class", "protocol", "enum", "actor", "typealias"]
DEFINING = ["exported_symbol", "swift_decl_type"]
INJECTED_SCORE = 600
EVIDENCE = ["query", "id", "term", "layer", "hit_type", "base"]


def _evidence(rows: DataFrame, layer: int, hit_type: Column, base: Column) -> DataFrame:
    return rows.select("query", "id", "term", F.lit(layer).alias("layer"), hit_type.alias("hit_type"), base.alias("base"))


def by_name(terms: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Rows of names (id, name, kind) whose name is a term, the first of each term by kind and file: found once for each term, however many queries ask for it."""
    met = names.join(terms.select("term").distinct(), F.lower("name") == F.lower("term"))
    place = F.row_number().over(Window.partitionBy("term").orderBy("kind", "id", "name"))
    return met.withColumn("place", place).filter(F.col("place") <= limit).drop("place").join(terms, "term")


def passes_gate(fan_in: Column) -> Column:
    """A plain word needs a file that many import, or the very case of a name with capitals."""
    distinctive = (F.col("name") == F.col("term")) & ~F.col("term").rlike("^[a-z0-9]+$")
    return fp.is_code_shaped(F.col("term")) | distinctive | (F.coalesce(fan_in, F.lit(0)) >= PLAIN_FAN_IN)


def symbol_layer(terms: DataFrame, exports: DataFrame, fan: DataFrame) -> DataFrame:
    chain = F.col("kind") == "explicit"
    met = by_name(terms, exports, 50).join(fan.hint("merge"), "id", "left").filter(chain | passes_gate(F.col("fan_in")))
    return _evidence(met, 1, F.when(chain, "reexport_chain").otherwise("exported_symbol"), F.when(chain, CHAIN).otherwise(SYMBOL))


def declaration_layer(terms: DataFrame, declarations: DataFrame) -> DataFrame:
    is_type = F.col("kind").isin(TYPE_KINDS)
    return _evidence(by_name(terms, declarations, 50), 2, F.when(is_type, "swift_decl_type").otherwise("swift_decl_other"), F.when(is_type, SYMBOL).otherwise(DECLARED))


def chain_layer(terms: DataFrame, reexports: DataFrame) -> DataFrame:
    """All re-exports of a name: each further hop only finds rows that the name has found."""
    met = reexports.join(terms, F.lower("name") == F.lower("term"))
    return _evidence(met, 3, F.lit("reexport_chain"), F.lit(CHAIN))


def token_layer(terms: DataFrame, exports: DataFrame, files: DataFrame, found: DataFrame, cap: DataFrame, limit: int = 20) -> DataFrame:
    """Names that hold a term as a part, where no layer before has found anything for the query; parts that very many files have don't count."""
    open_terms = terms.join(found.select("query").distinct(), "query", "left_anti")
    parts = exports.select("id", "name", "kind", F.explode(name_tokens(F.col("name"))).alias("token"))
    # only parts that are terms are counted: all rows of such a part stay
    asked = parts.join(open_terms.select(F.lower("term").alias("token")).distinct(), "token", "left_semi")
    rare = asked.groupBy("token").agg(F.countDistinct("id").alias("df")).join(F.broadcast(cap), F.col("df") <= F.col("cap"))  # one row
    met = asked.hint("merge").join(rare, "token").join(open_terms.select("term").distinct(), F.col("token") == F.lower("term"))
    place = F.row_number().over(Window.partitionBy("term").orderBy("kind", "id", "name"))
    kept = met.withColumn("place", place).filter(F.col("place") <= limit).join(open_terms, "term").join(files.select("id", "path").hint("merge"), "id").filter(~fp.is_test_of_graph(F.col("path")))
    chain = F.col("kind") == "explicit"
    return _evidence(kept, 5, F.when(chain, "reexport_chain").otherwise("export_token"), F.when(chain, CHAIN).otherwise(TOKEN))


def path_layer(terms: DataFrame, files: DataFrame, *, most: int = 10, borderline: bool = False) -> DataFrame:
    """Files whose path holds a term that few paths hold."""
    met = holding(files, "path", terms.select("term").distinct())
    of_term = Window.partitionBy("term")
    # one more than count tells that a term has too many; the others are dropped before they are shuffled
    first = met.withColumn("place", F.row_number().over(of_term.orderBy("id"))).filter(F.col("place") <= most + 1)
    kept = first.withColumn("n", F.count("*").over(of_term)).filter(F.col("n") <= most).withColumn("class", fp.match_class(F.col("term"), F.col("path"))).join(terms, "term")
    kept = kept.filter(F.col("class") != "loose") if borderline else kept
    return _evidence(kept, 6, F.lit("path_match"), F.when(F.col("class").isin("stem-exact", "dir-segment"), STRONG_PATH).otherwise(PATH))


def strongest(evidence: list[DataFrame], terms: DataFrame) -> DataFrame:
    """One row per query and file: its best evidence, the earliest among equals, and all terms that matched."""
    every = reduce(DataFrame.unionByName, evidence).join(terms.select("query", "term", "ord"), ["query", "term"])
    best = F.min_by(F.struct("hit_type", "base"), F.struct(-F.col("base"), "layer", "ord"))
    out = every.groupBy("query", "id").agg(best.alias("best"), F.array_sort(F.collect_set("term")).alias("terms"))
    return out.select("query", "id", "best.*", "terms")


def ranked(found: DataFrame, files: DataFrame, fan: DataFrame, limit: int) -> DataFrame:
    """Scores with the fan-in part; where a query has a definition, the others lose half of theirs. Rounded before and after."""
    defines = found.groupBy("query").agg(F.max(F.col("hit_type").isin(DEFINING)).alias("defined"))
    part = F.col("base") * fan_in_fraction(F.col("fan_in"))
    first = F.round(F.col("base") + part, 2)
    less = F.round(F.greatest(F.lit(0.0), first - part * 0.5), 2)
    # merged: files and their fan-in grow with the tree, and small files would pass for small tables
    rows = found.join(files.select("id", "path").hint("merge"), "id").join(fan.hint("merge"), "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0))).join(defines, "query")
    scored = rows.withColumn("score", F.when(F.col("defined") & ~F.col("hit_type").isin(DEFINING) & (part > 0), less).otherwise(first))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("fan_in"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "id", "path", "hit_type", "terms", "fan_in", "score", "rank")


#: Endings of paths that a line's own signals depend on.
DIALECTS = [".py", ".swift", ""]


def line_hits(code: DataFrame, queries: DataFrame) -> DataFrame:
    """Lines (id, line_no, line, score, and before, the lines before it) that hold any term of a query (query, terms, and raw, its text), with what each says by itself.

    What a line defines and how its own signals count is told once for each distinct line
    and query: strict and loose are the signals of exact and of any case, one for each of
    the dialects.
    """
    queries = queries if "raw" in queries.columns else queries.withColumn("raw", F.lit(None).cast("string"))
    code = code if "before" in code.columns else code.withColumn("before", F.array().cast("array<string>"))
    asked = queries.select("query", F.explode("terms").alias("term"))
    found = holding(code.select("line").distinct(), "line", asked).select("query", "line").distinct().join(queries, "query")
    line, terms = F.col("line"), F.col("terms")
    told = found.withColumn("symbol", fc.symbol(line)).withColumn("noise", fc.noise_ratio(line))
    signals = lambda exact: F.array(*(fc.line_signals(line, F.lit(d), terms, F.col("symbol"), exact, F.col("noise"), fc.asks_extension(terms, F.col("raw"))) for d in DIALECTS))
    told = told.withColumns({"strict": signals(True), "loose": signals(False), "strict_site": fc.matches(F.col("symbol"), terms, True), "site": fc.matches(F.col("symbol"), terms), "coverage": fc.coverage_bonus(line, terms)})
    return code.join(told.drop("raw"), "line")


def own_signals(signals: Column, path: Column) -> Column:
    """A line's signals where it stands, with the type around it."""
    return fc.enclosing_share(F.col("before"), path, F.col("terms")) + reduce(lambda other, k: F.when(path.endswith(DIALECTS[k]), signals[k]).otherwise(other), range(len(DIALECTS) - 1), signals[len(DIALECTS) - 1])


def fused(graph: DataFrame, hits: DataFrame, files: DataFrame, limit: int, *, stale: bool = False) -> DataFrame:
    """Graph results (query, id, hit_type, score, fan_in) with the best line of each file: both scores add up, graph evidence counts more, both together more still (but for re-exports), definitions have a floor (but in tests). A stale graph gets none of this."""
    site = F.when(F.col("strict_site"), fc.SHARES["definition_site"]).otherwise(0.0)
    points = F.col("raw") * (1 + own_signals(F.col("strict"), F.col("path")) + site) + F.col("coverage")
    best = hits.withColumnRenamed("score", "raw").join(files.select("id", "path"), "id").withColumn("points", points)
    best = best.groupBy("query", "id").agg(F.max_by(F.struct("points", "line_no"), F.struct("points", -F.col("line_no"))).alias("best")).select("query", "id", F.col("best.points").alias("points"), F.col("best.line_no").alias("line_no"))
    both = graph.select("query", "id", "hit_type", F.col("score").alias("graph"), "fan_in").join(best, ["query", "id"], "full_outer").join(files.select("id", "path"), "id")
    own = F.coalesce(F.col("graph") * (1.0 if stale else 1.4), F.lit(0.0))
    agree = F.col("graph").isNotNull() & F.col("points").isNotNull() & (F.col("hit_type") != "reexport_chain")
    penalty = fp.merge_penalty(F.col("path"))
    score = (own + F.coalesce("points", F.lit(0.0))) * (F.lit(1.0) if stale else F.when(agree, 1.2).otherwise(1.0)) * (1 - penalty)
    floor = F.when(F.col("hit_type").isin(DEFINING) & (penalty != 0.25), (600.0 + own) * (1 - penalty)).otherwise(0.0)
    out = both.withColumn("fan_in", F.coalesce("fan_in", F.lit(0))).withColumn("fused", F.round(score if stale else F.greatest(score, floor), 2))
    order = Window.partitionBy("query").orderBy(F.desc("fused"), F.desc("fan_in"), "path")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "path", "hit_type", "line_no", "fan_in", "fused", "rank")


def hot_files(hits: DataFrame, fan: DataFrame) -> DataFrame:
    """Per query the files with at least the fifth highest fan-in among its files, two at least; none where there are fewer than five."""
    files = hits.select("query", "id").distinct().join(fan, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("fan_in")))
    fifth = files.select("query", "fan_in").withColumn("place", place).filter("place <= 5").groupBy("query").agg(F.when(F.count("*") == 5, F.greatest(F.min("fan_in"), F.lit(2))).alias("cut"))
    return files.join(F.broadcast(fifth), "query").select("query", "id", "fan_in", F.coalesce(F.col("fan_in") >= F.col("cut"), F.lit(False)).alias("hot"))


def adjusted(hits: DataFrame, files: DataFrame, hot: DataFrame) -> DataFrame:
    """Scores of lines by their file's role and their own signals, as shares of the base; where a query has a definition site, files without one lose half of their graph part, else hot ones lose theirs."""
    path, base, line = F.col("path"), F.col("score"), F.col("line")
    rows = hits.join(files.select("id", "path"), "id").join(hot, ["query", "id"])
    flag = lambda name, holds: F.when(holds, fc.SHARES[name]).otherwise(0.0)
    entry, hub, fan = flag("entry", fp.is_entry_point(path)), flag("hot", F.col("hot")), fan_in_fraction(F.col("fan_in"))
    role = flag("test", fp.is_test_path(path)) + flag("vendor", fp.is_vendor(path)) + flag("doc", fp.is_doc(path))
    own = flag("export_line", fc.is_export_line(line)) + flag("definition_line", fc.is_definition_line(line)) + flag("definition_site", F.col("site")) + own_signals(F.col("loose"), path)
    scored = rows.withColumns({"first": F.greatest(F.lit(0.0), base * (1 + entry + hub + fan + role + own)), "graph_part": base * (entry + hub + fan), "hub_part": base * hub})
    of_file = scored.groupBy("query", "id").agg(F.max("site").alias("file_site"))
    of_query = of_file.groupBy("query").agg(F.max("file_site").alias("query_site"))
    seen = scored.join(of_file, ["query", "id"]).join(F.broadcast(of_query), "query")  # a row for each query
    cut = F.when(F.col("query_site"), F.when(F.col("file_site"), 0.0).otherwise(F.col("graph_part") * 0.5)).otherwise(F.col("hub_part"))
    return seen.withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.col("first") - cut), 6)).select("query", "id", "path", "line_no", "score", "fan_in", "adjusted")


def injected(matches: DataFrame, present: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Files that names point to and text search has missed: per query the best by a match's weight (query, id, term, weight) and the path's authority."""
    fresh = matches.join(present.select("query", "id").distinct(), ["query", "id"], "left_anti").join(files.select("id", "path"), "id")
    scored = fresh.withColumn("standing", F.col("weight") * 10 + fp.authority(F.col("path")))
    best = scored.groupBy("query", "id", "path").agg(F.min_by(F.struct("standing", "term"), F.struct(-F.col("standing"), "ord")).alias("best"))
    order = Window.partitionBy("query").orderBy(F.desc("best.standing"), "path")
    kept = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return kept.select("query", "id", "path", F.col("best.term").alias("term"), F.col("best.standing").alias("standing"), "place")


def roles(ranked_files: DataFrame, *, top: int = 3, hazard: int = 15) -> DataFrame:
    """What a file of a ranked list is for: witness (a test), primary (defines, or among the first others) or support; and whether many import it."""
    test = fp.is_test_path(F.col("path"))
    others = F.sum(F.when(test, 0).otherwise(1)).over(Window.partitionBy("query").orderBy("rank"))
    role = F.when(test, "witness").when(F.col("hit_type").isin(DEFINING) | (others <= top), "primary").otherwise("support")
    return ranked_files.select("query", "path", "rank", role.alias("role"), (F.col("fan_in") >= hazard).alias("hazard"))


def blast_radius(edits: DataFrame, edges: DataFrame, ties: DataFrame, touched: DataFrame, *, least: int = 3, confidence: float = 0.4, partners: int = 2) -> DataFrame:
    """After an edit (session, id): how many files import it, how many of those the session hasn't touched, and its surest co-change partners (ties: id, other, count, confidence) that it hasn't either."""
    imports = edges.filter("to_path is not null").select(F.col("to_path").alias("id"), F.col("from_path").alias("other")).distinct()
    seen = touched.select("session", F.col("id").alias("other")).distinct().withColumn("seen", F.lit(1))
    # merged: what grows with the tables isn't gathered, however small its files are
    deps = edits.join(imports.hint("merge"), "id").join(seen.hint("merge"), ["session", "other"], "left")
    deps = deps.groupBy("session", "id").agg(F.count("*").alias("dependents"), F.count_if(F.col("seen").isNull() & (F.col("other") != F.col("id"))).alias("untouched"))
    surest = lambda *by: Window.partitionBy(*by).orderBy(F.desc("confidence"), F.desc("count"), "other")
    placed = ties.filter(F.col("confidence") >= confidence).withColumn("at", F.row_number().over(surest("id")))
    # No cut: of a file's first n + partners ties, a session that touched n files leaves as many partners as are shown.
    reach = edits.join(touched.groupBy("session").agg(F.count("*").alias("n")).hint("merge"), "session", "left").withColumn("reach", F.coalesce("n", F.lit(0)) + partners).drop("n")
    close = reach.join(placed.hint("merge"), "id").filter("at <= reach").join(seen.hint("merge"), ["session", "other"], "left_anti")
    close = close.withColumn("place", F.row_number().over(surest("session", "id"))).filter(F.col("place") <= partners).groupBy("session", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("partners"))
    out = deps.filter((F.col("dependents") >= least) & (F.col("untouched") > 0)).join(close, ["session", "id"], "full_outer")
    return out.select("session", "id", F.coalesce("dependents", F.lit(0)).alias("dependents"), F.coalesce("untouched", F.lit(0)).alias("untouched"), F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"))


def stem_tokens(path: Column) -> Column:
    """Distinct lower-case words of a file's name without its extension, of three letters or more: cut at case changes and at all but letters."""
    # The patterns of extensions, case changes and what isn't a letter.
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    words = F.split(F.regexp_replace(stem, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z]+")
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= 3))


def terms_of_new(new_files: DataFrame, exported: DataFrame) -> DataFrame:
    """(query, term, ord): the words of new files' names (id, path), then the names they export (id, name), but for default and those of one or two characters."""
    words = new_files.select(F.col("id").alias("query"), F.posexplode(stem_tokens(F.col("path"))).alias("at", "term")).withColumn("part", F.lit(0))
    names = exported.filter((F.length("name") >= 3) & (F.col("name") != "default")).select(F.col("id").alias("query"), F.lit(0).alias("at"), F.col("name").alias("term"), F.lit(1).alias("part"))
    first = words.unionByName(names).groupBy("query", "term").agg(F.min(F.struct("part", "at")).alias("first"))
    return first.select("query", "term", F.row_number().over(Window.partitionBy("query").orderBy("first", "term")).alias("ord"))


def sprawl(new_files: DataFrame, exported: DataFrame, layers, files: DataFrame, fan: DataFrame, *, most: int = 3, looked_at: int = 8) -> DataFrame:
    """Existing files that a new one may be a second version of: every new file is a query of its own, and layers gives the evidence for all terms at once.

    Of the first eight results the best three that are neither tests nor the file itself.
    Files that exist, or that no index takes, aren't new. What is found depends on the list
    of terms alone, so new files with one list share the search of the first of them.
    """
    # merged: what grows with the tables isn't gathered, however small its files are
    fresh = new_files.join(files.select("path").hint("merge"), "path", "left_anti").filter(fp.is_indexable(F.col("path")))
    every = terms_of_new(fresh, exported.join(fresh.select("id").hint("merge"), "id", "left_semi"))
    lists = written(every.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("list")), "new-lists")
    asking = lists.groupBy("list").agg(F.min("query").alias("first"))
    terms = written(asking.select(F.col("first").alias("query"), F.inline("list")).select("query", "term", "ord"), "new-terms")
    best = ranked(strongest(layers(terms), terms), files, fan, looked_at).filter(~fp.is_test_path(F.col("path")))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    found = best.withColumn("place", place).filter(F.col("place") <= most).select(F.col("query").alias("first"), "path", F.col("hit_type").alias("reason"), "place")
    return lists.join(asking.hint("merge"), "list").select("query", "first").join(found.hint("merge"), "first").drop("first")
