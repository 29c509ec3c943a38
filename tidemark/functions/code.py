"""What a line of code says: what it defines, exports or imports, and how much of it is noise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_SWIFT = r"^\s*(?:@[\w.()\s,:\"=<>?!*+-]+\s+)*(?:public\s+|internal\s+|fileprivate\s+|private\s+|open\s+)?"
#: Patterns of definitions; the first that matches names the symbol.
DEFINITIONS = [
    r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", r"^\s*class\s+(\w+)(?:\s*\(|\s*:)", r"^\s*@\w+.*\n\s*(?:async\s+)?def\s+(\w+)", r"^([A-Z][A-Z0-9_]+)\s*=", r"^(\w+)\s*:\s*\w+\s*=",
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_$][\w$]*)\s*(?::[^=]+)?\s*=(?!\s*(?:require\s*\(|import\s*[(\s]))\s", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
    r"^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", r"^\s*\w+\.(\w+)\s*=\s*function\s+\w+", r"^\s*(?:module\.)?exports\.(\w+)\s*=", r"^\s*(?:export\s+)?(?:interface|type)\s+(\w+)",
    r"^func\s+(?:\([^)]+\)\s+)?(\w+)", r"^type\s+(\w+)", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"^\s*(?:pub\s+)?struct\s+(\w+)", r"^\s*(?:pub\s+)?enum\s+(\w+)",
    _SWIFT + r"(?:final\s+|indirect\s+)?(?:class|struct|protocol|actor|enum)\s+(\w+)", _SWIFT + r"typealias\s+(\w+)", r"^\s*associatedtype\s+(\w+)", _SWIFT + r"extension\s+([\w.]+)",
    _SWIFT + r"(?:convenience\s+|required\s+|override\s+)*(init)\??!?\s*[<(]", r"^\s*(deinit)\s*\{",
    _SWIFT + r"(?:static\s+|class\s+|final\s+|override\s+|mutating\s+|nonmutating\s+|convenience\s+|required\s+|dynamic\s+)*func\s+(\w+)",
    _SWIFT + r"(?:static\s+|class\s+|final\s+|override\s+)*(subscript)\s*[<(]",
    _SWIFT + r"(?:static\s+|class\s+|final\s+|override\s+|lazy\s+|weak\s+|unowned\s+)*(?:var|let)\s+(\w+)\s*(?::[^={]+)?\s*[:={](?!\s*(?:require\s*\(|import\s*[(\s]))",
    r"^\s*case\s+(\w+)(?:\s*\(|\s*=|\s*$|\s*,)", r"^\s*(?:infix|prefix|postfix)\s+operator\s+(\S+)",
]
#: Words that say little about what a line is for.
NOISE = """const let var function class return import export from require module exports default if else for while switch case break continue try catch finally throw new this true false null undefined void typeof instanceof
async await yield static public private protected readonly extends implements interface type enum abstract def self cls None and or not in is as with pass lambda global nonlocal assert raise except elif print len str int float bool
list dict set tuple range super property staticmethod classmethod isinstance hasattr getattr setattr func init deinit guard defer throws rethrows inout weak unowned lazy mutating nonmutating convenience required final dynamic override
open fileprivate internal Self where repeat Any AnyObject associatedtype typealias subscript willSet didSet""".split()
#: Shares of a line's score that its signals add or take.
SHARES = {
    "entry": 0.10, "hot": 0.15, "test": -0.25, "vendor": -0.50, "doc": -0.40, "export_line": 0.05, "definition_line": 0.03, "definition_site": 0.25, "exact_symbol": 0.40, "export_match": 0.10,
    "symbol_contains": 0.12, "python_public": 0.08, "docstring": 0.05, "enclosing_type": 0.10, "extension_target": 0.15, "noise_high": -0.15, "noise_mid": -0.08,
}
COVERAGE_STEP = 15


def symbol(line: Column) -> Column:
    """What a line defines; null if nothing."""
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in DEFINITIONS))


def noise_ratio(line: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(line, "[^a-zA-Z0-9_]", " "), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.lower(w).isin(NOISE))) / F.size(words)).otherwise(0.0)


def holds_any(text: Column, terms: Column) -> Column:
    """Whether a text has any of the terms in it, whatever the case."""
    return F.exists(terms, lambda t: F.lower(text).contains(F.lower(t)))


def is_export_statement(line: Column, terms: Column) -> Column:
    exporting = line.rlike(r"^\s*export\s+") | line.rlike(r"^\s*(?:module\.)?exports[\s.=]") | line.rlike(r"^\s*__all__\s*=")
    return exporting & holds_any(line, terms)


def is_export_line(line: Column) -> Column:
    return line.rlike(r"^\s*export\b")


def is_definition_line(line: Column) -> Column:
    kinds = [r"^\s*(export\s+)?(default\s+)?(async\s+)?function\b", r"^\s*(export\s+)?(default\s+)?class\b", r"^\s*export\s+(const|let|var|type|interface)\b", r"^\s*(async\s+)?def\s+\w+", r"^\s*class\s+\w+"]
    return reduce(or_, map(line.rlike, kinds))


def is_public_python(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1).rlike("^[^_]")


def extension_target(line: Column) -> Column:
    return F.nullif(F.substring_index(F.regexp_extract(line, _SWIFT + r"extension\s+([\w.]+)", 1), ".", 1), F.lit(""))


def enclosing_type(before: Column) -> Column:
    """The nearest type that opens in the lines before, given in order."""
    named = F.transform(before, lambda x: F.regexp_extract(x, _SWIFT + r"(?:final\s+|indirect\s+)?(?:class|struct|protocol|actor|enum|extension)\s+([\w.]+)", 1))
    return F.substring_index(F.try_element_at(F.filter(named, lambda x: x != ""), F.lit(-1)), ".", 1)


def matches(name: Column, terms: Column, exact_case: bool = False) -> Column:
    """Whether a name is one of the terms; false for no name."""
    own = name if exact_case else F.lower(name)
    return F.coalesce(F.exists(terms, lambda t: own == (t if exact_case else F.lower(t))), F.lit(False))


def line_signals(line: Column, path: Column, terms: Column, defined: Column, exact_case: bool = False, noise: Column | None = None, asks_extension: Column | None = None) -> Column:
    """Sum of the shares that a line's own signals add; defined is its symbol, noise its noise ratio where it's known, asks_extension whether the query is shaped like one for an extension, see there."""
    share = lambda name, holds: F.when(holds, SHARES[name]).otherwise(0.0)
    within = F.exists(terms, lambda t: (defined if exact_case else F.lower(defined)).contains(t if exact_case else F.lower(t)))
    noise, python, swift = noise_ratio(line) if noise is None else noise, path.endswith(".py"), path.endswith(".swift")
    total = share("exact_symbol", matches(defined, terms, exact_case)) + share("export_match", is_export_statement(line, terms)) + share("symbol_contains", F.coalesce(within, F.lit(False)))
    total = total + F.when(noise > 0.7, SHARES["noise_high"]).when(noise > 0.5, SHARES["noise_mid"]).otherwise(0.0)
    total = total + share("python_public", python & is_public_python(line) & holds_any(line, terms)) + share("docstring", python & line.rlike("^\\s*(\"{3}|'{3}|#)") & holds_any(line, terms))
    shaped = F.size(terms) >= 2 if asks_extension is None else asks_extension
    return total + share("extension_target", swift & shaped & matches(extension_target(line), terms))


def asks_extension(terms: Column, raw: Column) -> Column:
    """A query of several terms, or whose text has a + or the word extension."""
    return (F.size(terms) >= 2) | F.coalesce(raw.contains("+") | raw.rlike(r"(?i)\bextension\b"), F.lit(False))


def enclosing_share(before: Column, path: Column, terms: Column) -> Column:
    """What a Swift line gets for the type around it: the nearest that opens in the lines before."""
    return F.when(path.endswith(".swift") & matches(enclosing_type(before), terms), SHARES["enclosing_type"]).otherwise(0.0)


def coverage_bonus(line: Column, terms: Column) -> Column:
    """Points for every further term that a line holds."""
    held = F.size(F.filter(terms, lambda t: F.lower(line).contains(F.lower(t))))
    return F.when(held > 1, (held - 1) * COVERAGE_STEP).otherwise(0)
