"""Which prompts call for a search, and the terms to search for.

A prompt is cut to tokens with their places; a token's shape says whether it names a path
or an identifier, and a table of noise words (a parameter) which others say nothing.
Signals of the prompt are rows that meet a table of rules and their weights; the sum is
held against thresholds.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of paths.
PATH_EXTENSIONS = """.js .ts .jsx .tsx .mjs .cjs .mts .cts .py .pyw .swift .swiftinterface .rb .go .rs .java .kt .scala .c .cpp .cc .h .hpp .cs .fs .php .lua .ex .exs .erl .sh .bash .zsh .json .yaml .yml .toml .xml .ini .cfg
.css .scss .sass .less .html .htm .vue .svelte .sql .graphql .gql .md .rst .txt .dockerfile .tf .proto""".split()
#: Shapes of identifiers.
IDENTIFIERS = ["^[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*$", "^[A-Z][a-zA-Z0-9]*[a-z][a-zA-Z0-9]*$", "^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$", "^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$", "^[A-Z]{2,}[a-z][a-zA-Z0-9]*$|^[A-Z]{2,}$"]
#: Whole prompts that ask for nothing, and marks of notes.
PHRASES = [
    "yes", "no", "ok", "okay", "sure", "yep", "yup", "nope", "nah", "go ahead", "do it", "go for it", "proceed", "continue", "thanks", "thank you", "ty", "thx", "lgtm", "looks good", "looks good to me", "looks great", "perfect", "great", "awesome", "nice", "cool",
    "got it", "understood", "i see", "makes sense", "done", "finished", "complete", "completed", "approved", "ship it", "yes please", "no thanks", "yes do it", "please do", "sounds good", "sounds great", "sounds right", "right", "correct", "exactly", "indeed",
]
MARKERS = ["todo", "fixme", "hack", "xxx", "note", "wip", "tbd"]
#: Patterns of what a prompt says.
ACTION = r"(?i)^(fix|add|update|change|remove|delete|create|move|rename|refactor|implement|replace|rewrite|merge|split|extract|convert|modify|debug|test|check|verify|clean|optimize|improve|handle|set|build|install|enable|disable|ensure)\b"
QUESTION = r"(?i)^(where|what|how|which|find|show|list)\b"
DEFINITION = r"(?i)\b(where\s+is|what\s+file|what\s+imports|what\s+exports|dependents?\s+of|dependencies?\s+of|who\s+calls|who\s+uses|defined\s+in|declaration\s+of|definition\s+of|imported\s+by|exported\s+by|called\s+from)\b"
IMPORT = r"\b(import|require|from)\s+['\"`]|import\s*\(|require\s*\("
TRACE = r"\b(Error|TypeError|ReferenceError|SyntaxError|at\s+\w+\s*\(|Traceback|raise\s+\w+|panic:|ENOENT|EACCES|EPERM|errno|stack\s*trace)\b"
GIT = r"(?i)^\s*(git\s+|commit\s|push\s|pull\s|rebase\s|merge\s|stash\s|cherry-pick|tag\s|revert\s|checkout\s|clone\s|fetch\s|diff\s|log\s|status\s|reset\s|deploy\s|publish\s|release\s)"
SMALL_TALK = r"(?i)^(thank|thanks|hello|hi|hey|good\s+(morning|afternoon|evening)|sounds?\s+good|great|perfect|awesome|nice|cool|got\s+it|understood|i\s+see|makes?\s+sense|nevermind|never\s+mind|forget\s+it|scratch\s+that|wait|hold\s+on|one\s+moment|sorry|oops|my\s+bad|no\s+worries|np|nvm)\b"
FENCE = "^```"
#: What each signal adds, the least sum of a sure search and of a doubtful one, terms of a search, and words beyond which a prompt is long or very long.
WEIGHTS = {"identifier": 3, "path": 4, "question": 3, "action": 3, "trace": 2, "import": 3, "definition": 3, "empty": -3, "git": -4, "small_talk": -3, "very_long": -2, "fence": -2, "terms": 1}
SURE, STRICT, PERMISSIVE, MOST_TERMS, LONG, VERY_LONG = 3, 2, 1, 6, 80, 200


def says(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, with words of ASCII letters, digits and _ alone: Java's own boundary takes an accented letter for a part of the word."""
    return text.rlike(pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"))


def looks_like_path(token: Column) -> Column:
    return token.contains("/") | F.lower(F.regexp_extract(token, r"^.+(\.[^.]*)$", 1)).isin(PATH_EXTENSIONS)


def has_identifier_shape(token: Column) -> Column:
    return (F.length(token) >= 2) & reduce(or_, (token.rlike(p) for p in IDENTIFIERS))


def tokens(prompts: DataFrame, noise: DataFrame) -> DataFrame:
    """(id, place, term, is_path, is_identifier, kept): each token without what stands around it; kept unless it is short, or one of the noise words (term, lower-case)."""
    each = prompts.select("id", F.posexplode(F.split("said", r"[\s\p{Z}﻿]+")).alias("place", "raw"))
    cleaned = F.regexp_replace(F.regexp_replace("raw", "^[^a-zA-Z0-9_/.]+", ""), "[^a-zA-Z0-9_/.]+$", "")
    each = each.withColumn("cleaned", cleaned).withColumn("candidate", F.regexp_replace("cleaned", r":\d+(?::\d+)?$", ""))
    each = each.withColumn("is_path", (F.col("cleaned") != "") & looks_like_path(F.col("candidate"))).withColumn("is_identifier", ~F.col("is_path") & has_identifier_shape(F.col("cleaned")))
    known = noise.select(F.col("term").alias("word")).distinct().withColumn("noise", F.lit(True))
    met = each.withColumn("word", F.lower("cleaned")).join(known, "word", "left")
    kept = (F.length("cleaned") >= 2) & (F.col("is_path") | F.col("is_identifier") | F.col("noise").isNull())
    return met.select("id", "place", F.when(F.col("is_path"), F.col("candidate")).otherwise(F.col("cleaned")).alias("term"), "is_path", "is_identifier", kept.alias("kept"))


def rules(spark, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "rule string, weight int")


def classified(prompts: DataFrame, noise: DataFrame, *, weights: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(id, retrieve, terms, confidence, score) of prompts (id, prompt), ids being distinct.

    Empty prompts, commands, phrases and marks ask for nothing, nor do those without a term;
    a single plain word is searched with little confidence. score is null where it isn't
    asked for.
    """
    said = F.regexp_replace(F.coalesce("prompt", F.lit("")), r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$", "")
    given = prompts.select("id", said.alias("said"))
    of_token = tokens(given, noise).groupBy("id").agg(
        F.count("*").alias("words"), F.count_if("is_identifier").alias("identifiers"), F.count_if("is_path").alias("paths"), F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("place", "term")))).alias("kept"),
    )
    rows = given.join(of_token, "id").withColumn("terms", F.transform(F.slice("kept", 1, MOST_TERMS), lambda x: x["term"])).drop("kept")
    told, n = F.col("said"), F.size("terms")
    bare = (F.col("identifiers") == 0) & (F.col("paths") == 0)
    signals = {
        "identifier": F.col("identifiers") > 0, "path": F.col("paths") > 0, "question": says(told, QUESTION) & (F.col("words") >= 3) & (~bare | says(told, DEFINITION) | says(told, IMPORT)), "action": says(told, ACTION) & ~bare, "trace": says(told, TRACE), "import": says(told, IMPORT),
        "definition": says(told, DEFINITION), "empty": (F.col("words") < 4) & bare & (n == 0), "git": says(told, GIT) & bare, "small_talk": says(told, SMALL_TALK) & bare, "very_long": (F.col("words") > VERY_LONG) & (F.col("paths") == 0), "fence": says(told, FENCE) & bare, "terms": (F.col("words") <= LONG) & (n > 0),
    }
    held = rows.select("id", F.explode(F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in signals.items())))).alias("rule"))
    sums = held.join(weights if weights is not None else rules(prompts.sparkSession), "rule").groupBy("id").agg(F.sum("weight").alias("score"))
    scored = rows.join(sums, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))

    plain = F.trim(F.regexp_replace(F.lower(told), "[.!?,]+$", ""))
    nothing = (told == "") | told.startswith("/") | told.startswith("!") | plain.isin(PHRASES) | F.regexp_replace(plain, ":$", "").isin(MARKERS)
    single = (F.col("words") == 1) & bare
    word = (n == 1) & F.lower(F.get("terms", F.lit(0))).rlike("^[a-z][a-z0-9_-]{2,}$")
    score, least = F.col("score"), STRICT if strict else PERMISSIVE
    # retrieve, confidence, whether terms are given, whether the score was asked for
    answer = lambda retrieve, confidence, terms, asked: F.struct(F.lit(retrieve).alias("retrieve"), confidence.cast("double").alias("confidence"), F.lit(terms).alias("given"), F.lit(asked).alias("asked"))
    fixed = lambda retrieve, confidence, terms, asked: answer(retrieve, F.lit(confidence), terms, asked)
    verdict = (
        F.when(nothing, fixed(False, 1.0, False, False)).when(single & word, fixed(True, 0.3, True, False)).when(single, fixed(False, 0.9, False, False)).when(n == 0, fixed(False, 0.7, False, True))
        .when(score >= SURE, answer(True, F.least(F.lit(1.0), 0.5 + (score - SURE) * 0.1), True, True)).when(score >= least, fixed(True, 0.4, True, True)).otherwise(answer(False, F.greatest(F.lit(0.1), 0.3 + score * 0.05), True, True))
    )
    out = scored.withColumn("v", verdict)
    none = F.array().cast("array<string>")
    return out.select("id", "v.retrieve", F.when(F.col("v.given"), F.col("terms")).otherwise(none).alias("terms"), F.round("v.confidence", 6).alias("confidence"), F.when(F.col("v.asked"), score).alias("score"))
