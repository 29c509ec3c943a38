"""Imports and exports of source files by patterns, and the files that imports mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of imports and exports with their kinds, and of what lists exports.
IMPORTS = [
    ("import", r"(?m)^\s*import\s+(?:type\s+)?[\s\S]{0,500}?\sfrom\s*[\"']([^\"']+)[\"']"), ("import", r"(?m)^\s*import\s*[\"']([^\"']+)[\"']"),
    ("export-from", r"(?m)^\s*export\s+[\s\S]{0,500}?\sfrom\s*[\"']([^\"']+)[\"']"), ("dynamic", r"\bimport\s*\(\s*[\"']([^\"']+)[\"']\s*\)"), ("require", r"\brequire\s*\(\s*[\"']([^\"']+)[\"']\s*\)"),
]
EXPORTS = [
    ("named", r"\bexport\s+(?:async\s+)?function\s+([A-Za-z0-9_$]+)"), ("named", r"\bexport\s+class\s+([A-Za-z0-9_$]+)"), ("named", r"\bexport\s+(?:const|let|var)\s+([A-Za-z0-9_$]+)"),
    ("type", r"\bexport\s+type\s+([A-Za-z0-9_$]+)"), ("type", r"\bexport\s+interface\s+([A-Za-z0-9_$]+)"), ("cjs-named", r"\bexports\.([A-Za-z0-9_$]+)\s*="),
]
EXPORT_LIST, DEFAULT, WHOLE = r"\bexport\s*\{\s*([^}]+)\s*\}(?!\s*from)", r"\bexport\s+default\b", r"\bmodule\.exports\s*="
BLOCK_COMMENT, LINE_COMMENT = r"/\*[\s\S]*?\*/", r"(?m)^\s*//.*$"
#: Extensions in the order in which they are tried, and what a written one stands for where a TypeScript file imports.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
TYPED = [".ts", ".tsx", ".mts", ".cts"]
REWRITES = {".js": [".ts", ".tsx"], ".jsx": [".tsx", ".ts"], ".mjs": [".mts", ".ts"], ".cjs": [".cts", ".ts"]}
#: Extensions of assets; files of configuration at the root, in order, and how many they inherit from; entries of a package that names none.
ASSETS = r"\.(css|scss|sass|less|styl|png|jpe?g|gif|webp|svg|ico|bmp|tiff|woff2?|ttf|otf|eot|mp4|webm|mov|mp3|wav)$"
CONFIGS, EXTENDS_DEPTH = ["tsconfig.json", "tsconfig.base.json", "jsconfig.json"], 4
ENTRIES = ["src/index.ts", "src/index.tsx", "src/index.js", "index.ts", "index.js"]


def without_comments(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source, BLOCK_COMMENT, ""), LINE_COMMENT, "")


def _named(found: Column, name: str, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x.alias(name), F.lit(kind).alias("kind")))


def _all(source: Column, patterns: list[tuple[str, str]], name: str) -> list[Column]:
    return [_named(F.regexp_extract_all(source, F.lit(p), F.lit(1)), name, kind) for kind, p in patterns]


def import_rows(sources: DataFrame) -> DataFrame:
    """(id, specifier, kind) of each source's imports, once each; a null source has none."""
    code = without_comments(F.col("source"))
    return sources.select("id", F.explode(F.array_distinct(F.concat(*_all(code, IMPORTS, "specifier")))).alias("x")).select("id", "x.*")


def export_rows(sources: DataFrame) -> DataFrame:
    """(id, name, kind) of each source's exports, once each; of `a as b` the name is b."""
    code = without_comments(F.col("source"))
    listed = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(EXPORT_LIST), F.lit(1)), lambda body: F.split(body, ",")))
    names = F.transform(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.trim(F.element_at(F.split(x, r"(?i)\s+as\s+"), -1)))
    whole = [_named(F.when(code.rlike(p), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), "name", kind) for p, kind in ((DEFAULT, "default"), (WHOLE, "cjs-default"))]
    return sources.select("id", F.explode(F.array_distinct(F.concat(*_all(code, EXPORTS, "name"), _named(names, "name", "named"), *whole))).alias("x")).select("id", "x.*")


def joined_path(folder: Column, specifier: Column) -> Column:
    """A relative specifier against a folder, with . and .. taken out; null if it leaves the root."""
    parts = F.filter(F.concat(F.filter(F.split(folder, "/"), lambda x: x != ""), F.split(specifier, "/")), lambda x: ~x.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda path, x: F.when(x != "..", F.concat(path, F.array(x))).when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1)))
    return F.array_join(walked, "/")


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def path_aliases(configs: DataFrame) -> DataFrame:
    """What each repository's configuration maps: (repo, pattern, deep, place, targets), targets as paths from the root with their star.

    configs: repo, path, extends, base_url, paths (array of pattern, targets). The first of the
    known files at the root counts; it inherits from the file it extends, four steps at most,
    and overrides that. Patterns keep the order in which the deepest file names them: deep
    first, then place. Extending a package, or a file outside the repository, counts for nothing.
    """
    order = F.array_position(F.array(*map(F.lit, CONFIGS)), F.col("path"))
    first = configs.filter(F.col("path").isin(CONFIGS)).groupBy("repo").agg(F.min_by("path", order).alias("path"))
    chain = [first.join(configs, ["repo", "path"]).withColumn("level", F.lit(0))]
    for level in range(1, EXTENDS_DEPTH + 1):
        named = F.when(F.col("extends").endswith(".json"), F.col("extends")).otherwise(F.concat("extends", F.lit(".json")))
        above = chain[-1].filter(F.col("extends").startswith(".")).select("repo", joined_path(_folder(F.col("path")), named).alias("path"))
        chain.append(above.join(configs, ["repo", "path"]).withColumn("level", F.lit(level)))
    every = reduce(DataFrame.unionByName, chain)
    base = every.filter("base_url is not null").groupBy("repo").agg(F.min_by("base_url", "level").alias("base_url"))
    listed = every.select("repo", "level", F.posexplode("paths").alias("place", "x")).select("repo", "level", "place", "x.*")
    merged = listed.groupBy("repo", "pattern").agg(F.min_by("targets", "level").alias("targets"), F.min_by("place", F.struct(-F.col("level"), "place")).alias("place"), F.max("level").alias("deep"))
    rooted = F.transform("targets", lambda t: F.when(~t.startswith("/"), joined_path(F.coalesce("base_url", F.lit("")), t)))
    return merged.join(base, "repo", "left").select("repo", "pattern", "deep", "place", rooted.alias("targets"))


def workspace_packages(packages: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(repo, name, dir, entries): packages (repo, dir, name, module, main, types) whose folder one of the repository's workspaces (repo, glob) takes in; of one name the last by folder."""
    glob = F.regexp_replace(F.regexp_replace("glob", r"^(\./)+", ""), "/+$", "")
    # stars take whole parts of a path in, one or any number
    quoted = F.regexp_replace(glob, r"([.+?^${}()|\[\]\\])", r"\\$1")
    any_number = F.regexp_replace(F.regexp_replace(quoted, r"/\*\*", "(?:/.<any>)?"), r"\*\*/", "(?:.<any>/)?")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(any_number, F.lit("*"), F.lit("[^/]*")), F.lit("<any>"), F.lit("*")), F.lit("$"))
    visible = packages.filter(~F.col("dir").rlike(r"(^|/)(\.|node_modules(/|$))") & (F.trim("name") != ""))
    taken = visible.join(workspaces.select("repo", pattern.alias("pattern")).distinct(), "repo").filter(F.rlike("dir", F.col("pattern")))
    entries = F.filter(F.concat(F.array("module", "main", "types"), F.array(*map(F.lit, ENTRIES))), lambda x: x.isNotNull() & (x != ""))
    return taken.groupBy("repo", "name").agg(F.max_by(F.struct("dir", entries.alias("entries")), "dir").alias("x")).select("repo", "name", "x.*")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _by_alias(bare: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attempts of specifiers (repo, specifier) through patterns: a pattern meets all specifiers that begin with what stands before its star."""
    fixed = F.substring_index("pattern", "*", 1)
    quoted = F.regexp_replace("pattern", r"([.+?^${}()|\[\]\\])", r"\\$1")
    rules = aliases.withColumns({"head": fixed, "regex": F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit("(.+)")), F.lit("$"))})
    heads = F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda n: F.substring(F.col("specifier"), F.lit(1), n))
    met = bare.select("repo", "specifier", F.explode(heads).alias("head")).join(rules, ["repo", "head"])
    starred = F.col("pattern").contains("*")
    met = met.filter(F.when(starred, F.rlike("specifier", F.col("regex"))).otherwise(F.col("specifier") == F.col("pattern")))
    star = F.when(starred, F.expr("regexp_extract(specifier, regex, 1)"))
    tried = met.withColumn("star", star).select("repo", "specifier", "deep", "place", "star", F.posexplode("targets").alias("at", "target"))
    filled = F.when(F.col("star").isNotNull() & F.col("target").contains("*"), F.concat(F.substring_index("target", "*", 1), "star", F.substr("target", F.instr("target", "*") + 1))).otherwise(F.col("target"))
    return tried.select("repo", "specifier", F.lit(1).alias("way"), (-F.col("deep")).alias("a"), F.col("place").alias("b"), F.col("at").alias("c"), joined_path(F.lit(""), filled).alias("base"))


def _by_package(bare: DataFrame, packages: DataFrame) -> DataFrame:
    """Attempts of specifiers through workspace packages: a package's entries, or the path inside it."""
    scoped = F.col("specifier").startswith("@")
    name = F.when(scoped, F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    met = bare.withColumn("name", name).join(packages, ["repo", "name"])
    inside = F.regexp_replace(F.substr("specifier", F.length("name") + 1), "^/+", "")
    tried = met.select("repo", "specifier", "dir", F.posexplode(F.when(inside == "", F.col("entries")).otherwise(F.array(inside))).alias("a", "entry"))
    zero = F.lit(0)
    return tried.select("repo", "specifier", F.lit(2).alias("way"), "a", zero.alias("b"), zero.alias("c"), F.when(~F.col("entry").startswith("/"), joined_path(F.col("dir"), F.col("entry"))).alias("base"))


def _candidates(base: Column, importer: Column) -> Column:
    """Files that a path may stand for: itself, and with an extension, where a TypeScript file imports, what it is compiled from; without one, extensions follow, then index files."""
    written, typed = _extension(base), _extension(importer).isin(TYPED)
    stem = base.substr(F.lit(1), F.length(base) - F.length(written))
    sources = reduce(lambda other, rule: F.when(typed & (written == rule[0]), F.array(*(F.concat(stem, F.lit(x)) for x in rule[1]))).otherwise(other), REWRITES.items(), F.array().cast("array<string>"))
    probed = F.array(*(F.concat(base, F.lit(x)) for x in EXTENSIONS), *(F.concat(base, F.lit(f"/index{x}")) for x in EXTENSIONS))
    at_root = F.array(*(F.lit(f"index{x}") for x in EXTENSIONS))
    return F.when(base == "", at_root).otherwise(F.concat(F.array(base), F.when(written != "", sources).otherwise(probed)))


def resolved(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Adds kind and to_path to imports (importer, specifier, and repo where there are several): the first candidate that is a file (path, and repo).

    Relative specifiers count from the importer's folder, those with a first slash from the
    root; assets (by extension, or with a query or fragment) from the importer's folder,
    found or not. All others go through aliases, in their order, then through workspace
    packages; what neither finds is external. Candidates meet files in an equi-join.
    Importers in Python have rules of their own, in python_imports.
    """
    single = "repo" not in imports.columns
    if single:
        imports, files = imports.withColumn("repo", F.lit(0)), files.withColumn("repo", F.lit(0))
    keys = ["repo", "importer", "specifier"]
    imports = imports.withColumn("specifier", F.coalesce("specifier", F.lit(""))).dropDuplicates(keys)
    spec = F.col("specifier")
    nothing, node, asset = spec == "", spec.startswith("node:"), spec.contains("?") | spec.contains("#") | spec.rlike(ASSETS)
    clean, here = F.regexp_extract(spec, "^[^?#]*", 0), _folder(F.col("importer"))
    local = F.when(asset & clean.startswith("/"), None).when(asset | spec.startswith("."), joined_path(here, clean)).when(spec.startswith("/"), joined_path(F.lit(""), spec))
    zero = F.lit(0)
    tried = imports.filter(~nothing & ~node).select(*keys, zero.alias("way"), zero.alias("a"), zero.alias("b"), zero.alias("c"), local.alias("base"))
    bare = imports.filter(~nothing & ~node & ~asset & ~spec.startswith(".") & ~spec.startswith("/"))
    distinct = bare.select("repo", "specifier").distinct()
    for rules, attempts in ((aliases, _by_alias), (packages, _by_package)):
        if rules is not None:
            rules = rules if "repo" in rules.columns else rules.withColumn("repo", F.lit(0))
            tried = tried.unionByName(bare.select(*keys).join(attempts(distinct, rules), ["repo", "specifier"]))
    probes = tried.filter("base is not null").select(*keys, "way", "a", "b", "c", F.posexplode(_candidates(F.col("base"), F.col("importer"))).alias("place", "path"))
    found = probes.join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    hit = found.groupBy(*keys).agg(F.min_by(F.struct(F.col("path").alias("to_path"), "way"), F.struct("way", "a", "b", "c", "place")).alias("x")).select(*keys, "x.*")
    missing = F.col("to_path").isNull()
    local_kind = lambda kind: F.when(missing, "unresolved").otherwise(kind)
    kind = F.when(nothing, "unresolved").when(node, "external").when(asset, "asset").when(spec.startswith("."), local_kind("relative")).when(spec.startswith("/"), local_kind("root"))
    out = imports.join(hit, keys, "left").withColumn("kind", kind.when(missing, "external").when(F.col("way") == 1, "tsconfig").otherwise("workspace")).drop("way")
    return out.drop("repo") if single else out
