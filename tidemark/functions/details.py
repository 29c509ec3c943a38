"""Labels of surfaced rows, spans, escapes and counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a row's detail begins, and the signal that it tells of; the first that fits counts.
DETAIL_SOURCES = [
    (r"^(exports\b|export match\b)", "exported_symbol"), (r"^defines\b", "swift_decl_type"), (r"^declares\b", "swift_decl_other"), (r"^re-export", "reexport_chain"),
    (r"^path match\b", "path_match"), (r"^export name", "export_token"),
]
DETAIL_SYMBOL = r"^(?:exports|defines|declares|re-exports?)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
SURFACED_ROW, SURFACED_LINE = r"^-\s+`([^`]+)`(?:\s+—\s+(.*))?$", r"\bL([0-9]+)"
HAZARD = r"^(\S+)\s+high fan-in"
#: Fixed value: longer samples count nothing.
LONGEST_SAMPLE = 2000
COUNTED_KINDS = ["changed", "invalidated"]


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def detail_source(detail: Column) -> Column:
    """The signal behind a detail; text_only for none and for all that no label begins."""
    d = F.trim(detail)
    found = F.lit("text_only")
    for pattern, source in reversed(DETAIL_SOURCES):
        found = F.when(d.rlike(pattern), source).otherwise(found)
    return found


def detail_symbol(detail: Column) -> Column:
    return _some(F.regexp_extract(F.trim(detail), DETAIL_SYMBOL, 1))


def surfaced_rows(block: Column) -> Column:
    """The rows of a rendered block, in order: path, source, line and symbol; lines that aren't rows are left out."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x.rlike(SURFACED_ROW))
    parts = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, SURFACED_ROW, 1)).alias("path"), _some(F.regexp_extract(x, SURFACED_ROW, 2)).alias("detail")))
    row = lambda p: F.struct(
        p["path"].alias("path"), detail_source(p["detail"]).alias("source"), _some(F.regexp_extract(p["detail"], SURFACED_LINE, 1)).cast("int").alias("line"), detail_symbol(p["detail"]).alias("symbol")
    )
    return F.transform(F.filter(parts, lambda p: p["path"] != ""), row)


def span_text(first: Column, last: Column, line: Column) -> Column:
    """A region as L1–9, one line as L1, an unknown place as ?."""
    region = F.when((last != first), F.concat(F.lit("L"), first.cast("string"), F.lit("–"), last.cast("string"))).otherwise(F.concat(F.lit("L"), first.cast("string")))
    return F.coalesce(F.when(first.isNotNull(), region), F.concat(F.lit("L"), line.cast("string")), F.lit("?"))


def hazard_path(note: Column) -> Column:
    return _some(F.regexp_extract(note, HAZARD, 1))


def escape_xml(text: Column) -> Column:
    # Characters and their entities, the ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_ticks(text: Column) -> Column:
    return F.replace(text, F.lit("`"), F.lit("\\`"))


def finite_count(value: Column) -> Column:
    """Whole counts of positive finite numbers; 0 for all else."""
    good = value.isNotNull() & ~F.isnan(value.cast("double")) & (value > 0) & (value.cast("double") < float("inf"))
    return F.when(good, F.floor(value)).otherwise(0)


def repo_matches(folder: Column, asked: str) -> Column:
    """Whether a session folder's name is that of the repository asked for, or ends with it after a hyphen; slashes count as hyphens."""
    low, plain = F.lower(folder), asked.lower().replace("/", "-").replace("\\", "-").lstrip("-")
    if not plain:
        return F.lit(False)
    return F.coalesce((low == asked.lower()) | (low == plain) | low.endswith(f"-{plain}"), F.lit(False))


def sample_count(sample: Column) -> Column:
    """How many findings of a JSON sample changed or were invalidated, whatever else the list holds; 0 for what is too long or isn't a list."""
    items = F.try_variant_get(F.try_parse_json(sample), "$", "array<variant>")
    counted = F.filter(items, lambda x: F.coalesce(F.try_variant_get(x, "$.kind", "string").isin(COUNTED_KINDS), F.lit(False)))
    return F.when(F.length(sample) <= LONGEST_SAMPLE, F.coalesce(F.size(counted), F.lit(0))).otherwise(0)


def iso_date(seconds: Column) -> Column:
    """The day of an epoch in UTC; null for none and for times before it."""
    return F.when(seconds > 0, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd"))
