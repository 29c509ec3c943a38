"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import jaccard, media, mixing, packing, quality, suffixes, token_files, tokens, toxicity, vectors, warc
from tidemark.llm.common import new_path

PASSAGE = " ".join(f"word{i}é" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "a b c d e f g"), (5, "A B C D E F G"), (6, PASSAGE), (7, f"{PASSAGE} tail of this one"), (8, PASSAGE), (9, "x" * 450), (10, "lorem ipsum " * 20_000),
    (11, f"start ß {PASSAGE}"), (12, " \n\t "), (13, "one"), (-4, "Ünïcode € text " * 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, spans string, kept string, copied int, mix string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "a" if i % 3 else None, None, 1, "t", "s", "k", 0, "m") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i, _ in TEXTS] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_tokens(spark, docs, none):
    for table, texts in ((docs, TEXTS), (none, [])):
        for unit in ("byte", "bit"):
            path = new_path(spark, "tokens")
            token_files.write_tokens(table, path, block_ids=1000, unit=unit)
            got, start = {r["doc_id"]: r for r in token_files.read_documents(spark, path).collect()}, 0
            for i, t in sorted(texts):
                ids = brute.token_ids(t)
                assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), brute.crc_of_ids(ids))
                start += len(ids)
            assert len(got) == len(texts)


def test_encoder_equals_the_library(monkeypatch):
    """Spaces beside all kinds of white space, characters that pattern engines class differently, added tokens, a store that starts anew."""
    import random

    draw = random.Random(7)
    pieces = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "a", "word", "Ünï", "don't", "'s", "12", "½", "²", "_", "...", "€", "😀", "中文", "<|endoftext|>", "x" * 60, "Ⅷ", "\u0301", ""]
    texts = [None, "", " ", "  ", " a", "a ", "a b ", "\n a", "a \n", *("".join(draw.choices(pieces, k=draw.randrange(12))) for _ in range(3000))]
    coder = tokens.Encoder(tokens.default_vocabulary())
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3000)
    got = [ids for i in range(0, len(texts), 100) for ids in coder.encode(texts[i : i + 100])]
    wanted = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == wanted


def test_columns_are_encoded_as_the_library_does_it(monkeypatch):
    """Contractions beside everything, slices of columns, batches that meet in a step, words too long to keep, columns of nothing but empty texts."""
    import random

    import pyarrow as pa

    draw = random.Random(11)
    pieces = ["'", "'", "'s", "'re", "'l", "'ll", "'ve", "'S", " ", " ", "\n", "\u3000", "s", "e", "é", "9", "٣", "!", "—", "l", "🙂", "\u0301", "x" * 70, " " * 70, "<|endof", "text|>", "<|endoftext|>"]
    texts = [None, "", *("".join(draw.choices(pieces, k=draw.randrange(9))) for _ in range(4000)), "'", "a'", "'r", "e"]
    monkeypatch.setattr(tokens, "BYTES_PER_STEP", 3000)
    monkeypatch.setattr(tokens, "BYTES_PER_CUT", 700)
    coder, got = tokens.Encoder(tokens.default_vocabulary()), {}
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 90, len(texts)))), pa.array(texts[i : i + 90])], names=["doc_id", "text"]) for i in range(0, len(texts), 90)]
    for ids, column in tokens.column_steps(batches):
        plain, ends = coder.encode_column(column)
        closed, stops = coder.encode_column(column, end=True)
        assert (stops - ends).tolist() == list(range(1, len(ids) + 1)) and (closed[stops - 1] == tokens.END_ID).all()
        assert np.delete(closed, stops - 1).tolist() == plain.tolist()
        got |= dict(zip(ids, (x.tolist() for x in np.split(plain, ends[:-1])), strict=True))
    assert [got[i] for i in range(len(texts))] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not any(len(w) > tokens.CACHE_BYTES for w in coder.words.at)
    for none in ([], [None], ["", ""], ["<|endoftext|>"]):
        ids, ends = coder.encode_column(pa.array(none, pa.string()), end=True)
        assert len(ids) == len(none) + sum(map(bool, none)) and len(ends) == len(none)


def test_known_words_cost_less_than_a_cut_by_pattern():
    """The encoder's own share, once words are known, against the cut of the same texts by a pattern, with which it began before."""
    import re
    import time

    import pyarrow.dataset as ds

    texts = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].combine_chunks().to_pylist()
    pattern = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    coder = tokens.Encoder(tokens.default_vocabulary())
    coder.encode(texts)

    def least(step) -> float:
        took = []
        for _ in range(5):
            began = time.process_time()
            step()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: coder.encode(texts)) < least(lambda: [pattern.findall(t or "") for t in texts])


def test_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.1]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0])]
    wanted = brute.vector_links(rows, 0.95)
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, node int, bucket int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table).collect()} == wanted
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_media(spark, docs, none):
    for table, texts in ((docs, TEXTS), (none, [])):
        path = new_path(spark, "media")
        media.store_texts(table, path)
        got = {r["doc_id"]: r for r in media.read_stored(spark, path).collect()}
        assert len(got) == len(texts)
        assert all(got[i]["payload_sha256"] == hashlib.sha256(brute.payload(t)).hexdigest() for i, t in texts)


def test_embedded_media_is_carved(spark):
    inner = media.encode_media(b"\xff" * 576)
    blob = b"RIFF BM P5 junk" + inner[1] + b"more"
    table = spark.createDataFrame([(blob, inner[0]), (None, "image/png"), (b"", None)], "media binary, declared string")
    row, *rest = media.sniff_column(table).collect()
    assert row["true_type"] == media.UNKNOWN and row["corrected"]
    found = row["embedded"][0]
    assert media.carve(blob, found["offset"], found["length"]) == inner[1]
    assert all(r["true_type"] == media.UNKNOWN and not r["embedded"] for r in rest)


def test_classifiers(docs, none, labels):
    for scores in (toxicity.toxicity(docs, labels), quality.quality(docs, labels), toxicity.toxicity(docs, labels.limit(0)), quality.quality(docs, labels.limit(0))):
        rows = scores.collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(none, labels).count() == quality.quality(none, labels).count() == 0


def test_offending_sentences_are_found(spark):
    rows = [(i, f"fine words here number {i}. {'you idiot scum' if i % 4 == 0 else 'nothing bad'}. more text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, text in rows:
        assert got[i]["predicted"] == (i % 4 == 0)
        assert [text[s["start"] : s["end"]].strip() for s in got[i]["offending"]] == (["you idiot scum"] if i % 4 == 0 else [])


def test_mixing(docs, none):
    rows = mixing.mix(docs.drop("mix")).collect()
    assert {r["doc_id"] for r in rows} <= {i for i, _ in TEXTS}
    assert mixing.mix(none.drop("mix")).count() == 0
    budget = mixing.mix(docs.drop("mix"), budget_tokens=1000).collect()
    assert sum(r["mix"]["tokens"] for r in budget) <= 1000


def test_jaccard(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_sets(docs).collect()}
    assert got == brute.jaccard_components(TEXTS)
    assert jaccard.similar_sets(none).count() == 0


def test_warc(spark):
    magic = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, None), (2, ""), (3, f"x{magic}{magic}y"), (4, "same"), (5, "same"), (6, magic), (7, "é" * 3000), (8, "\r\n\r\n")]
    table = spark.createDataFrame([(i, None if i == 2 else "http://a b/", h, "d") for i, h in pages], "page_id long, url string, html string, digest string")
    for rows, wanted in ((table, brute.archives(pages)), (table.limit(0), {})):
        path = new_path(spark, "warc")
        warc.write_archives(rows, path)
        got = warc.read_archives(spark, path).collect()
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == wanted


def test_packing(docs, none):
    from tests.llm.test_contracts import check_packing

    got = packing.pack(docs).collect()
    assert len(check_packing(got, TEXTS)) == brute.bins_by_plain_best_fit([r["length"] for r in got], 1024)
    assert packing.pack(none).count() == 0


def test_suffixes(docs, none):
    got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.remove_repeats(docs).collect()}
    assert got == brute.without_repeats(TEXTS, 200)
    texts = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, as_text=True, carry=["spans", "kept"]).collect()}
    for i, t in TEXTS:
        assert "�" not in texts[i]["kept"] and len(texts[i]["kept"].encode()) - (got[i][0] - got[i][1]) in range(0, 4 * 2 * max(1, got[i][2]))
        assert texts[i]["carried"]["kept"] == "k"
    assert suffixes.remove_repeats(none).count() == 0


def test_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "same text " * 40), (1, "same text " * 40), (None, "other " * 90), (2, "alone")], "doc_id long, text string")
    assert suffixes.remove_repeats(rows).count() == jaccard.similar_sets(rows).count() == packing.pack(rows).select("doc_id", "piece", "sequence_id", "offset").distinct().count() == 4
