"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import vectors, warc
from tidemark.llm.common import new_path


def test_vectors_that_share_no_bucket_are_linked(spark, monkeypatch):
    """Lone pairs just over and just under the threshold, with buckets that hardly any pair shares."""
    monkeypatch.setattr(vectors, "tables_for", lambda count, threshold, recall: (40, 1))
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng, rows = np.random.default_rng(5), []
    for dim in (64, 48):
        for k in range(200):
            a, b = rng.normal(size=(2, dim))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            cosine = 0.9502 if k % 2 else 0.9498
            rows += [(len(rows), a.tolist()), (len(rows) + 1, (cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)).tolist())]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    wanted = brute.vector_links(rows, 0.95)
    assert sum(n for n, _ in wanted.values()) == 400
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == wanted


def test_records_with_long_headers_and_those_after_them_are_read(spark):
    pages = [(1, "first"), (2, "second"), (3, "first"), (4, "x WARC/1.0\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n y")]
    rows = spark.createDataFrame([(i, "http://a/" + "u" * 40_000 if i < 3 else "http://b/", h) for i, h in pages], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(rows, path)
    got = warc.read_archives(spark, path).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == brute.archives(pages)


MAGIC = "WARC/1.0\r\nWARC-Type: revisit\r\n"
HOSTILE = [
    f"{MAGIC}Payload-Length: x\r\nContent-Length: 0\r\n\r\n\r\n\r\n", f"{MAGIC}Content-Length: {'9' * 5000}\r\n\r\n", f"{MAGIC}WARC-Record-ID: <urn:page:{'1' * 23}>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    "WARC/1.0\r\n" * 300, "\r\n\r\nWARC/1.", "WARC/1.", "\r\n\r\n" * 50, f"é {MAGIC}Content-Length: 20000\r\n\r\n", "WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 80,
]


@pytest.mark.parametrize(("bytes_a_range", "compression"), [(600, "none"), (1 << 20, "none"), (600, "gzip")])
def test_hostile_payloads_and_byte_ranges(spark, bytes_a_range, compression):
    pages = [(i, h) for i, h in enumerate([*HOSTILE, "plain " * 400, *HOSTILE, "".join(HOSTILE), "", None])]
    rows = spark.createDataFrame([(i, ("http://a/WARC/1.0", "http://b/" + "u" * 100_000, None)[i % 3], h) for i, h in pages], "page_id long, url string, html string").repartition(2)
    path = new_path(spark, "warc")
    warc.write_archives(rows, path, compression=compression)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, str(bytes_a_range))
        got = warc.read_archives(spark, path).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == brute.archives(pages)
    assert len(got) == len(pages)


def test_a_broken_chain_is_an_error(spark):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nabc"
    path = new_path(spark, "warc")
    spark.createDataFrame([(record.format(1, 3),), (record.format(2, 9),)], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="no whole record at byte"):
        warc.read_archives(spark, path)
