"""The ten queries over whole small tables, against plain versions of their contracts."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm import brute
from tests.oracle import spark_rows, sql_rows
from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


def test_op1(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_token_planes")}
    assert len(got) == len(texts)
    start = 0
    for doc_id, text in sorted(texts):
        ids = brute.token_ids(text)
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc_of_ids(ids))
        start += len(ids)


def test_op2(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted = brute.vector_links(rows, 0.95)
    got = rows_of(spark, "op2_rotation_codes")
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_op3(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op3_signature_sniffing")}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        raw, r = brute.payload(text), got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(raw))
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(raw[-32:])
    same = defaultdict(set)
    for doc_id, text in texts:
        same[text].add(tuple(got[doc_id])[1:])
    assert all(len(x) == 1 for x in same.values())


def held_out(spark, name, column, threshold):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows_of(spark, name)
    assert len({r["doc_id"] for r in got}) == len(got) == 1000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in got)
    test = [r for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    return got, [labels[r["doc_id"]] for r in test], [r["score"] for r in test]


def test_op4(spark):
    got, labels, scores = held_out(spark, "op4_toxic_sentences", "toxic", 0.5)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert brute.auc(labels, scores) >= 0.95


def test_op5(spark):
    columns, rows = spark_rows(queries.QUERIES["op5_temperature_mixing"](spark, SF))
    wanted_columns, wanted = sql_rows(SF, queries.ORACLE_SQL["op5_temperature_mixing"])
    assert columns == wanted_columns and rows == wanted


def test_op6(spark, texts):
    got = rows_of(spark, "op6_prefix_orders")
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard_components(texts)


def test_op7(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = rows_of(spark, "op7_warc_chain")
    assert len(got) == len(pages)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == brute.archives(pages)


def check_packing(got, texts, capacity=1024):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for doc_id, text in texts:
        ids, own = brute.token_ids(text), sorted(pieces.pop(doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == brute.crc_of_ids(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return bins


def test_op8(spark, texts):
    got = rows_of(spark, "op8_best_fit_packing")
    bins = check_packing(got, texts)
    assert len(bins) == brute.bins_by_plain_best_fit([r["length"] for r in got], 1024)


def test_op9(spark):
    got, labels, scores = held_out(spark, "op9_kernel_quality", "quality", 0.7)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert brute.auc(labels, scores) >= 0.95
    clean = [s for s, y in zip(scores, labels, strict=True) if y == 1]
    assert sum(s >= 0.7 for s in clean) >= 0.97 * len(clean)


def test_op10(spark, texts):
    got = rows_of(spark, "op10_bucket_refinement")
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.without_repeats(texts, 200)
