"""Canonical JSON: one text for all spellings of a value, and deduplication by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of JSON without spaces: strings, numbers, all else.
TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def _let(value: Column, use) -> Column:
    """An expression that uses a value several times and computes it once."""
    return F.transform(F.array(value), use)[0]


def number_text(value: Column) -> Column:
    """A double as JavaScript writes it: the shortest digits, plain from 1e-6 up to 1e21, with an exponent beyond."""

    def shortest(size: Column) -> Column:
        # the JVM's own text may have a digit more than it needs
        shorter = [F.format_string(f"%.{p}e", size) for p in (0, 14, 15, 16)]
        return F.upper(F.coalesce(*(F.when(s.cast("double") == size, s) for s in shorter), size.cast("string")))

    def parts(text: Column) -> Column:
        mantissa = F.substring_index(text, "E", 1)
        exponent = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        part = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
        return F.struct(F.substring_index(mantissa, ".", 1).alias("whole"), part.alias("part"), exponent.alias("exponent"))

    def place(x: Column) -> Column:
        # the value is 0.digits times ten to the power of point
        every = F.concat(x["whole"], x["part"])
        bare = F.regexp_replace(every, "^0+", "")
        return F.struct(F.regexp_replace(bare, "0+$", "").alias("digits"), (F.length(x["whole"]) + x["exponent"] - (F.length(every) - F.length(bare))).alias("point"))

    def written(x: Column) -> Column:
        digits, point, one = x["digits"], x["point"], F.lit(1)
        n = F.length(digits)
        power = F.concat(F.when(point - 1 < 0, "-").otherwise("+"), F.abs(point - 1).cast("string"))
        scientific = F.concat(F.substr(digits, one, one), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), n))).otherwise(""), F.lit("e"), power)
        return (
            F.when(digits == "", "0").when((point >= n) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), point - n))).when((point > 0) & (point <= 21), F.concat(F.substr(digits, one, point), F.lit("."), F.substr(digits, point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).otherwise(scientific)
        )

    text = _let(_let(_let(_let(F.abs(value), shortest), parts), place), written)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def _string(token: Column) -> Column:
    """Escapes of control characters with small letters."""
    small = reduce(lambda t, c: F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*\\u00[01]){c}", f"$1{c.lower()}"), "ABCDEF", token)
    return F.when(token.contains("\\u00"), small).otherwise(token)


def canonical_json(text: Column) -> Column:
    """JSON without spaces, the keys of every object in order of their UTF-16 units, at any depth.

    VARIANT keeps an object's fields in that order; numbers are doubles then written as
    JavaScript does. Null for null and for what isn't JSON, or names a key of one object twice.
    """
    sorted_text = F.to_json(F.try_parse_json(text))
    tokens = F.regexp_extract_all(sorted_text, F.lit(TOKENS), F.lit(0))
    # too large a number is no finite double
    double = lambda t: _let(t.cast("double"), lambda d: F.when(F.abs(d) < float("inf"), number_text(d)).otherwise("null"))
    short = r"^(0|-?[1-9][0-9]{0,14})$"  # whole numbers are written as they are
    written = F.transform(tokens, lambda t: F.when(t.rlike(short), t).when(t.rlike("^-?[0-9]"), double(t)).when(t.startswith('"'), _string(t)).otherwise(t))
    return F.array_join(written, "")


def unique_sorted(findings: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Of each group's findings with one canonical text the first by order, numbered by that text; those that aren't JSON don't count."""
    spelled = findings.groupBy(group, text).agg(F.min(order).alias(order), F.count("*").alias("n"))  # each spelling is read once
    # the count keeps the optimizer from reading every row's text before they are grouped
    canonical = spelled.withColumn("canonical", canonical_json(F.when(F.col("n") > 0, F.col(text)))).filter("canonical is not null")
    first = canonical.groupBy(group, "canonical").agg(F.min_by(F.struct(order, text), order).alias("first"), F.sum("n").alias("copies"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("canonical"))).select(group, "place", "canonical", "first.*", "copies")
