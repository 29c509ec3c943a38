"""What prompts call for, by hand."""

from tidemark.operators import prompts

NOISE = "the is in how git commit fix where defined please a of work does thanks check".split()
CASES = {
    None: (False, [], 1.0, None), "  ": (False, [], 1.0, None), "/help graph.js": (False, [], 1.0, None), "!ls": (False, [], 1.0, None), "Yes please!": (False, [], 1.0, None), "TODO:": (False, [], 1.0, None), "FIXME": (False, [], 1.0, None),
    "retrieval": (True, ["retrieval"], 0.3, None), "the": (False, [], 0.9, None), "42": (False, [], 0.9, None), "graph.js": (True, ["graph.js"], 0.7, 5), "URL": (True, ["URL"], 0.6, 4), "the git commit": (False, [], 0.7, -3), "git commit the": (False, [], 0.7, -7), "static payload": (False, ["static", "payload"], 0.35, 1),
    "fix rerankFiles please": (True, ["rerankFiles"], 0.9, 7), "where is the resolver": (True, ["resolver"], 0.9, 7), "how does retrieval work": (False, ["retrieval"], 0.35, 1), "check (lib/graph.js:42:8), MAX_RETRIES": (True, ["lib/graph.js", "MAX_RETRIES"], 1.0, 11), "import 'x' please": (True, ["import"], 0.6, 4),
    "git commit resolver": (False, ["resolver"], 0.15, -3), "thanks resolver": (False, ["resolver"], 0.2, -2), "```\nresolver text": (False, ["resolver", "text"], 0.25, -1), "TypeError in the resolver": (True, ["TypeError", "resolver"], 0.8, 6), "panic: resolver": (False, ["panic", "resolver"], 0.35, 1),
    "a1 b2 c3 d4 e5 f6 g7": (False, ["a1", "b2", "c3", "d4", "e5", "f6"], 0.35, 1), "word " * 81: (False, ["word"] * 6, 0.3, 0), "word " * 201: (False, ["word"] * 6, 0.2, -2), "Traceback " + "word " * 81: (True, ["Traceback", *["word"] * 5], 0.7, 5), "stack trace " + "word " * 81: (True, ["stack", "trace", *["word"] * 4], 0.4, 2),
}


def test_prompts(spark):
    table = spark.createDataFrame(list(enumerate(CASES)), "id int, prompt string").repartition(4)
    noise = spark.createDataFrame([(w,) for w in NOISE], "term string")
    got = {r["id"]: (r["retrieve"], r["terms"], r["confidence"], r["score"]) for r in prompts.classified(table, noise).collect()}
    for k, (prompt, wanted) in enumerate(CASES.items()):
        assert got[k] == wanted, prompt
    loose = {r["id"]: (r["retrieve"], r["confidence"]) for r in prompts.classified(table, noise, strict=False).collect()}
    assert loose[list(CASES).index("static payload")] == (True, 0.4) and loose[list(CASES).index("git commit resolver")][0] is False
    heavier = prompts.rules(spark, prompts.WEIGHTS | {"terms": 3})
    assert {r["id"]: r["retrieve"] for r in prompts.classified(table, noise, weights=heavier).collect()}[list(CASES).index("static payload")]
    assert prompts.classified(table.limit(0), noise).count() == 0


def test_words_end_at_other_letters(spark):
    """As in the patterns' own language: an accented letter is no part of a word."""
    cases = {"one momentÉeaux thing": (False, -2), "fixé rerankFiles": (True, 7), "éTypeError thing": (True, 6)}
    table = spark.createDataFrame(list(enumerate(cases)), "id int, prompt string")
    got = {r["id"]: (r["retrieve"], r["score"]) for r in prompts.classified(table, spark.createDataFrame([("the",)], "term string")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
