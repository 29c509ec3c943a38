"""Stages of the pipeline against plain versions, with null and repeated ids."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.oracle import sql_rows
from tidemark.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (1, "alone " + " ".join(f"a{i}" for i in range(30))), (1, "unlike " + " ".join(f"b{i}" for i in range(30))), (2, LONG), (2, LONG), (3, LONG + " end"), (None, LONG + " other end"),
    (None, "lone " + " ".join(f"c{i}" for i in range(30))), (None, "solo " + " ".join(f"d{i}" for i in range(30))), (None, " ".join(f"e{i}" for i in range(60))), (None, " ".join(f"e{i}" for i in range(61))),
    (4, None), (4, None), (None, ""), (None, None), (5, LONG.upper()),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_jaccard_stage(spark, docs):
    classes = brute.jaccard_components([(k, t) for k, (_, t) in enumerate(ROWS)])
    members: dict[int, list] = {}
    for k, (i, t) in enumerate(ROWS):
        members.setdefault(classes[k][1] if classes[k][0] else -1 - k, []).append((i is None, i or 0, k))
    kept = corpus_pipeline.ngram_jaccard(spark, docs, SF)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == docs.columns
    # two null ids of one class are of equal rank
    loose = {(None, ROWS[8][1]), (None, ROWS[9][1])}
    wanted = Counter(ROWS[min(m)[2]] for m in members.values())
    assert sum(got[x] for x in loose) == sum(wanted[x] for x in loose) == 1
    assert {x: n for x, n in got.items() if x not in loose} == {x: n for x, n in wanted.items() if x not in loose}


def test_suffix_stage(spark, docs):
    cut = brute.without_repeats([(k, t) for k, (_, t) in enumerate(ROWS)], 200)
    got = corpus_pipeline.suffix_array(spark, docs, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got) == Counter((i, cut[k][3]) for k, (i, _) in enumerate(ROWS))


def by_row(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_quality_stage(spark):
    """The documents that the query of the classifier accepts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = {r["doc_id"] for r in queries.QUERIES["op9_kernel_quality"](spark, SF).collect() if r["predicted"] == 1}
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < len(accepted) < docs.count()
    assert by_row(kept.collect()) == by_row(r for r in docs.collect() if r["doc_id"] in accepted)


def packed(rows, texts):
    """Checks the pieces of a list of texts, ids repeated or not, and the number of sequences."""
    wanted, lengths = Counter(), []
    for i, t in texts:
        ids = brute.token_ids(t)
        first = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        at = 0
        for piece, n in enumerate([first, *[1024] * ((len(ids) - first) // 1024)]):
            wanted[i, piece, at, n, brute.crc_of_ids(ids[at : at + n])] += 1
            lengths.append(n)
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) == brute.bins_by_plain_best_fit(lengths, 1024)


def test_mixing_and_packing_stages(spark, tmp_path):
    """The mix that the SQL gives, and a packing of its rows as plain best fit makes it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    assert mixed.columns == docs.columns
    names, rows = sql_rows(SF, queries.ORACLE_SQL["op5_temperature_mixing"])
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r[names.index("doc_id")] for r in rows)
    few = docs.limit(60).unionByName(docs.limit(5))
    packed(corpus_pipeline.best_fit_packing(spark, few, SF).collect(), [(r["doc_id"], r["text"]) for r in few.collect()])


def test_run(spark, tmp_path):
    """All five stages in turn: the rows of run are those of plain versions of what each stage keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = {r["doc_id"] for r in queries.QUERIES["op9_kernel_quality"](spark, SF).collect() if r["predicted"] == 1}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in accepted]
    classes = brute.jaccard_components([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if not classes[r[0]][0] or classes[r[0]][1] == r[0]]
    whole = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cut = {r["doc_id"]: r["kept"] for r in suffixes.remove_repeats(whole, as_text=True).collect()}
    plain = brute.without_repeats([(i, t) for i, t, _ in rows], suffixes.LENGTH)
    # characters that a run covers in part stay
    assert all(len(cut[i].encode()) - (plain[i][0] - plain[i][1]) in range(0, 8 * plain[i][2] + 1) for i, _, _ in rows)
    kept = spark.createDataFrame([(i, cut[i], "en", s, len(cut[i])) for i, _, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept.coalesce(1).write.parquet(str(tmp_path / "documents"))
    (next((tmp_path / "documents").glob("part-*.parquet"))).rename(tmp_path / "documents.parquet")
    names, mixed = sql_rows(str(tmp_path), queries.ORACLE_SQL["op5_temperature_mixing"])
    texts = [(r[names.index("doc_id")], cut[r[names.index("doc_id")]]) for r in mixed]
    packed(corpus_pipeline.run(spark, SF).collect(), texts)
