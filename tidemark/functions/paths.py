"""What a path says about a file: its type, its role, whether it may be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that name their own type; code among them.
TYPES = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "json", "py", "swift", "md"]
CODE_TYPES = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "swift"]
#: Patterns of path roles, as regular expressions.
SAMPLES = r"(?i)(^|/)(fixtures?|tests?|__tests__|specs?|examples?|demos?|samples?|e2e|mocks?)/"
WEB_ENTRY = r"(?i)(^|/)(main|index|app|root|router|routes)\.(ts|tsx|js|jsx|mjs|cjs)$"
PYTHON_ENTRY = r"(?i)(^|/)(__init__|__main__|app|manage|wsgi|asgi)\.py$"
SWIFT_ENTRY = [r"(^|/)(main|AppDelegate)\.swift$", r"(^|/)[A-Z][A-Za-z0-9_]*App\.swift$"]
TEST_FOLDER, TEST_NAME = r"(?i)(^|/)(__tests__|__test__|tests?|specs?)/", r"(?i)(^|/)test_[^/]*\.[a-z0-9]+$|(^|/)[^/]*_test\.[a-z0-9]+$"
SWIFT_TESTS = [r"(^|/)XCT[A-Za-z0-9_]+/", r"(^|/)[A-Za-z0-9_]+Testing/"]
GRAPH_TESTS = r"(?i)(^|/)(tests?|__tests__|spec|XCT\w+|\w+Testing)(/|$)|(^|/)test_[^/]*$|[._-]test\.[a-z]+$|[._-]spec\.[a-z]+$|_test\.go$"
VENDOR = r"(?i)(^|/)(node_modules|dist|build|coverage|\.next|out|vendor)/"
DOCS, DOC_NAMES = r"(?i)\.(md|rst|txt|adoc)$", r"(?i)^(CHANGELOG|CHANGES|History|NEWS|RELEASE|UPGRADING|MIGRATION)"
#: Names, extensions and templates of files that may hold secrets.
SECRET_NAMES = [".npmrc", ".pypirc", ".netrc", "_netrc", ".git-credentials", ".htpasswd", "credentials", "credentials.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SECRET_EXTENSIONS = ["pem", "key", "p12", "pfx", "jks", "keystore", "ppk", "asc"]
TEMPLATES = ["example", "sample", "template", "dist", "defaults"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty where the only dot leads the name."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def normal(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def file_type(path: Column) -> Column:
    kind = extension(normal(path))
    return F.when(kind.isin(TYPES), kind).otherwise("other")


def is_indexable(path: Column) -> Column:
    p = normal(path)
    inside = [p.contains(f"/{d}/") for d in ("node_modules", ".git", ".planning", ".claude", "dist", "build", ".next")]
    barred = (p == "") | p.startswith(".")
    for x in inside:
        barred = barred | x
    return ~barred & file_type(p).isin(CODE_TYPES)


def is_entry_point(path: Column) -> Column:
    named = path.rlike(WEB_ENTRY) | path.rlike(PYTHON_ENTRY) | path.rlike(SWIFT_ENTRY[0]) | path.rlike(SWIFT_ENTRY[1])
    return named & ~path.rlike(SAMPLES)


def is_test_path(path: Column) -> Column:
    """As ranked retrieval sees it."""
    return path.rlike(TEST_FOLDER) | path.rlike(SWIFT_TESTS[0]) | path.rlike(SWIFT_TESTS[1]) | path.rlike(r"(?i)\.(test|spec)\.") | path.rlike(TEST_NAME)


def is_test_of_merge(path: Column) -> Column:
    """As the fused merge sees it: in a name, test and spec only before js or ts."""
    return path.rlike(TEST_FOLDER) | F.lower(path).rlike(r"\.(test|spec)\.[jt]s$") | path.rlike(TEST_NAME) | path.rlike(SWIFT_TESTS[0]) | path.rlike(SWIFT_TESTS[1])


def is_test_of_graph(path: Column) -> Column:
    return path.rlike(GRAPH_TESTS)


def is_sample_path(path: Column) -> Column:
    """As the summary's entry points see it."""
    return path.rlike(SAMPLES)


def is_vendor(path: Column) -> Column:
    return path.rlike(VENDOR)


def is_doc(path: Column) -> Column:
    return path.rlike(DOCS) | base_name(path).rlike(DOC_NAMES)


def authority(path: Column) -> Column:
    """2 for sources, 1 for documentation, 0 for tests and samples."""
    sample = path.rlike(r"(?i)(^|/)(fixtures?|examples?|demos?|e2e|mocks?)/")
    return F.when(is_test_path(path) | sample, 0).when(is_doc(path) | path.rlike(r"(?i)(^|/)docs?/"), 1).otherwise(2)


def merge_penalty(path: Column) -> Column:
    """Share of a fused score that a path loses."""
    low = F.lower(path)
    doc = low.rlike(r"\.(md|rst|txt)$") | low.contains("/docs/") | low.contains("/doc/")
    return F.when(low.contains("/vendor/") | low.contains("/node_modules/"), 0.5).when(doc, 0.4).when(is_test_of_merge(path), 0.25).otherwise(0.0)


def is_sensitive(path: Column) -> Column:
    """May hold secrets, by folder, name or extension; templates of .env files may be shown."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    name = F.lower(base_name(p))
    folder = F.arrays_overlap(F.split(p, "/"), F.array(F.lit(".ssh"), F.lit(".gnupg")))
    env = (name == ".env") | (name.startswith(".env.") & ~F.substring_index(name, ".", -1).isin(TEMPLATES))
    return (name != "") & (folder | name.isin(SECRET_NAMES) | extension(p).isin(SECRET_EXTENSIONS) | env)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def stem_tokens(path: Column) -> Column:
    """Distinct alphabetic parts of a stem, of three letters or more, in lower case."""
    spaced = F.regexp_replace(stem(path), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.transform(F.split(spaced, "[^A-Za-z]+"), F.lower), lambda t: F.length(t) >= 3))


def match_class(term: Column, path: Column) -> Column:
    """How a term matches a path: its stem, a part of it, a folder, a part with two more letters at most, or anywhere."""
    t, low = F.regexp_replace(F.lower(term), r"^\.+|\.+$", ""), F.lower(path)
    own = F.regexp_replace(base_name(low), r"(?<=.)\.[^.]*$", "")
    parts = F.filter(F.split(own, r"[_\-.]+"), lambda x: x != "")
    folders = F.slice(F.split(low, "/"), F.lit(1), F.size(F.split(low, "/")) - 1)
    near = F.exists(parts, lambda x: (x.startswith(t) | x.endswith(t)) & (F.length(x) - F.length(t) <= 2))
    return F.when(t == "", "loose").when(own == t, "stem-exact").when(F.array_contains(parts, t), "stem-token").when(F.array_contains(folders, t), "dir-segment").when(near, "near").otherwise("loose")


def is_code_shaped(term: Column) -> Column:
    return term.contains("_") | term.contains(".") | term.rlike("[a-z][A-Z]") | (F.length(term) >= 10)
