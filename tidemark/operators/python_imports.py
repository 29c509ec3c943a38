"""Imports and exports of Python modules: their written form, and the files that imports mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def specifiers(statements: DataFrame) -> DataFrame:
    """(importer, specifier, kind) of statements (importer, statement import or from, module, level), once each: dots for the level, then the module."""
    level = F.coalesce("level", F.lit(0))
    written = F.when(F.col("statement") == "import", F.col("module")).otherwise(F.concat(F.repeat(F.lit("."), level), F.coalesce("module", F.lit(""))))
    kind = F.when(F.col("statement") == "import", "import").when(level > 0, "relative").otherwise("from")
    return statements.select("importer", written.alias("specifier"), kind.alias("kind")).distinct()


def public_names(modules: DataFrame) -> DataFrame:
    """(id, name, kind) of modules (id, functions, classes, constants, listed): the listed names where there is a list, else all.

    A listed name that the module doesn't define is passed on from elsewhere: explicit.
    """
    kind = lambda x: F.when(F.array_contains("classes", x), "class").when(F.array_contains("functions", x), "function").when(F.array_contains("constants", x), "const").otherwise("explicit")
    listed = F.transform("listed", lambda x: F.struct(x.alias("name"), kind(x).alias("kind")))
    of = lambda names, k: F.transform(F.array_distinct(names), lambda x: F.struct(x.alias("name"), F.lit(k).alias("kind")))
    defined = F.concat(of("functions", "function"), of("classes", "class"), of("constants", "const"))
    return modules.select("id", F.explode(F.when(F.col("listed").isNotNull(), listed).otherwise(defined)).alias("x")).select("id", "x.*")


def _files(base: Column) -> Column:
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), base)


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds to_path and kind to imports (importer, specifier).

    Relative ones climb a folder for each dot after the first. Absolute ones are local if
    their first part is a package or module at the root; one that a local package lacks is
    external. All candidates meet the files in one equi-join.
    """
    imports = imports.dropDuplicates(["importer", "specifier"])
    name = F.regexp_replace("specifier", r"^\.+", "")
    level, folders = F.length("specifier") - F.length(name), F.split("importer", "/")
    depth = F.size(folders) - level
    climbed = F.when(depth >= 0, F.slice(folders, 1, F.greatest(depth, F.lit(0))))
    base = F.array_join(F.concat(F.when(level > 0, climbed).otherwise(F.array().cast("array<string>")), F.filter(F.split(name, r"\."), lambda x: x != "")), "/")
    top = F.substring_index(name, ".", 1)
    own = F.array(F.when(base == "", "__init__.py").otherwise(F.concat(base, F.lit("/__init__.py"))))
    tried = F.when(level == 0, F.concat(_files(base), F.array(F.concat(top, F.lit("/__init__.py")), F.concat(top, F.lit(".py"))))).when(name == "", own).otherwise(_files(base))
    rows = imports.filter("specifier <> ''").select("importer", "specifier", F.posexplode(tried).alias("place", "path"))
    hits = rows.join(files.select("path"), "path", "left_semi").groupBy("importer", "specifier").agg(
        F.min_by("path", F.when(F.col("place") < 3, F.col("place"))).alias("inside"), F.max(F.col("place") == 3).alias("package"), F.max(F.when(F.col("place") == 4, F.col("path"))).alias("module")
    )
    relative = F.col("specifier").startswith(".")
    to_path = F.when(relative | F.col("package"), F.col("inside")).otherwise(F.col("module"))
    kind = F.when((F.col("specifier") == "") | (relative & F.col("to_path").isNull()), "unresolved").when(relative, "relative").when(F.col("to_path").isNull(), "external").otherwise("local")
    return imports.join(hits, ["importer", "specifier"], "left").withColumn("to_path", to_path).select("importer", "specifier", "to_path", kind.alias("kind"))
