"""URL rules by a sort-merge range join of hosts.

The labels of a host, last one first and each with a dot behind it, make its key: a rule's
host and all its subdomains are then the keys from the rule's own key on that are smaller
than the same with its last dot raised by one. Two such intervals are nested or apart. URLs
are dealt to blocks by hash, each block gets the rules, and both are sorted by key. The
sweep keeps a stack with one place for each number of labels: the last rule host of so many
labels that was passed, which is open as long as its interval's end isn't. The rules of the
open hosts whose path begins the URL's path fit; the longest decides.

Column functions only. A host that very many URLs share is spread over all blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without a ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _intervals(rules: DataFrame) -> DataFrame:
    """One row per rule host: level (its labels), low, high and the host's rules."""
    host, path, verdict = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path", "verdict"))
    named = rules.select(F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"), verdict.alias("verdict"))
    size = F.length("host") + F.length("path")
    each = F.struct(size.alias("size"), F.length("host").alias("host_size"), "verdict", "path", F.concat("host", "path").alias("rule"))
    labels = F.split("host", r"\.", -1)
    hosts = named.groupBy("host").agg(F.collect_set(each).alias("rules"))
    bare = F.array_join(F.reverse(labels), ".")
    some = F.col("host") != ""
    return hosts.select(
        F.when(some, F.size(labels)).otherwise(0).alias("level"), F.when(some, F.concat(bare, F.lit("."))).otherwise("").alias("low"),
        F.when(some, F.concat(bare, F.lit("/"))).alias("high"), "rules",
    )


def judge(pages: DataFrame, rules: DataFrame, *, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every URL by the longest rule (host, path, verdict) that fits it.

    Returns per row page_id, host, path, rule (host and path as one, null where none fits)
    and verdict (the rule's, else the default). Of rules of one length that with the longer
    host wins, and of the same rule with two verdicts the one that is later in the alphabet,
    so block before allow. A rule without a host fits every host; a path without any
    character is begun only by a rule without a path. Null URLs, and those without ://, have
    an empty host and path. Ids may repeat or be null; every row is judged alone. Other
    columns are not read. An empty table of rules gives the default everywhere.
    """
    blocks = partitions(pages.sparkSession)
    opened = _intervals(rules)
    levels = [r["level"] for r in opened.select("level").distinct().orderBy("level").collect()]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    block = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(blocks)).cast("int")
    placed = urls.select(block.alias("block"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path")
    dealt = opened.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("low").alias("key"), F.lit(0).alias("kind"), "level", "high", "rules")
    swept = placed.unionByName(dealt, allowMissingColumns=True)
    so_far = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = F.struct("high", "rules")
    stack = [F.last(F.when(F.col("level") == n, passed), ignorenulls=True).over(so_far).alias(f"level_{n}") for n in levels]
    found = swept.select("kind", "key", "page_id", "host", "path", *stack).filter("kind = 1")
    none = F.array().cast(opened.schema["rules"].dataType)
    active = [F.when(F.col(f"level_{n}.high").isNull() | (F.col("key") < F.col(f"level_{n}.high")), F.col(f"level_{n}.rules")) for n in levels]
    open_rules = reduce(F.concat, [F.coalesce(a, none) for a in active], none)
    fits = F.filter(open_rules, lambda r: F.startswith(F.col("path"), r["path"]))
    best = found.select("page_id", "host", "path", F.array_max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
