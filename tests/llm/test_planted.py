"""Planted links, hot groups, clashing names and texts with added tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import jaccard, media, mixing, packing, suffixes, token_files, toxicity, vectors
from tidemark.llm.common import new_path

RNG = np.random.default_rng(3)


def near(words, change):
    out = list(words)
    for k in RNG.choice(len(out), change, replace=False):
        out[k] = f"x{RNG.integers(1 << 40)}"
    return " ".join(out)


def links_of(texts):
    """(shingles, smallest linked id, number of links) of each document, all pairs compared."""
    sets = {i: brute.shingles(t) for i, t in texts}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * (n := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    root, count = brute.components(list(sets), links), dict.fromkeys(sets, 0)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return {i: (len(s), root[i], count[i]) for i, s in sets.items()}


@pytest.mark.parametrize("cut", [2048, 16])
def test_jaccard_with_hot_groups(spark, monkeypatch, cut):
    """Near copies of one text, unlike texts with one passage, a tie at exactly 75 %, exact copies; cuts of buckets and families that meet."""
    monkeypatch.setattr(jaccard, "CUT_NODES", cut)
    base, passage = [f"b{k}" for k in range(80)], [f"p{k}" for k in range(40)]
    texts = [near(base, int(RNG.integers(0, 5))) for _ in range(60)] + [" ".join([*passage, *(f"u{i}_{k}" for k in range(int(RNG.integers(2, 60))))]) for i in range(40)]
    texts += [" ".join(f"t{k}" for k in range(32)), " ".join([*(f"t{k}" for k in range(28)), *(f"v{k}" for k in range(0))]), texts[0].upper(), texts[0], "", None]
    rows = list(enumerate(texts))
    wanted = links_of(rows)
    assert max(n for _, _, n in wanted.values()) > 5 and len({r for _, r, _ in wanted.values()}) > 20
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.similar_sets(table).collect()}
    assert got == wanted


def test_a_bucket_gives_no_more_ties_than_rows():
    """Near copies share every token: what a bucket emits must not grow with the square of its rows."""
    tokens = np.sort(RNG.integers(1 << 60, size=120).astype(np.uint64))
    rows = [(0, True, k, 120, jaccard.profile(tokens), jaccard.short_names(tokens[:30]), jaccard.short_names(tokens[30:60])) for k in range(3000)]
    assert len(jaccard.tie_candidates(rows, False, 75)) == 2999


def test_frequent_grams_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FREQUENT", 5)
    passage = " ".join(f"word{k}" for k in range(70))
    texts = [(k, f"own {k * 7919} {passage} end {k * 104729}") for k in range(30)] + [(99, "nothing else " * 3)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"])) for r in suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: v[:3] for i, v in brute.without_repeats(texts, 200).items()}


def test_vectors_planted_chain_and_repeated_ids(spark):
    def at(cosine, a):
        b = RNG.normal(size=64)
        b -= (a @ b) * a
        return cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)

    first = RNG.normal(size=64)
    first /= np.linalg.norm(first)
    vs = [first]
    for _ in range(8):  # a chain whose ends are far apart
        vs.append(at(0.96, vs[-1]))
    centre = RNG.normal(size=64)
    centre /= np.linalg.norm(centre)
    vs += [at(0.985, centre) for _ in range(40)] + list(RNG.normal(size=(60, 64)))
    wanted = brute.vector_links(list(enumerate([v.tolist() for v in vs])), 0.95)
    assert sum(n for n, _ in wanted.values()) > 100
    ids = [k // 2 if k > 80 else k for k in range(len(vs))]  # some ids stand for two vectors
    rows = [(None if k == 105 else ids[k], v.tolist()) for k, v in enumerate(vs)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["n_links"] for r in got) == sorted(n for n, _ in wanted.values())
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None and r["vec_id"] < 40} == {k: wanted[k][1] for k in range(40)}
    assert sum(r["vec_id"] is None for r in got) == 1 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_added_tokens_are_found_as_the_library_finds_them(spark):
    texts = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|><|endoftext|>"), (3, "no token <|endof"), (3, "same id"), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path)
    got = sorted((r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(spark, path).collect())
    ids = [brute.token_ids(t) for _, t in texts]
    assert got == sorted((len(x), brute.crc_of_ids(x)) for x in ids)
    assert sorted(r["ids_crc32"] for r in packing.pack(docs).collect()) == sorted(map(brute.crc_of_ids, ids))


def test_clashing_and_dotted_names(spark):
    rows = [(k, "some words " * (k % 9 + 1), "abc"[k % 3], "old", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix string, `a.b` int")
    mixed = mixing.mix(docs)
    assert mixed.columns.count("mix") == 1 and mixed.select("mix.tokens", "`a.b`").count() == mixed.count() > 0
    named = mixing.mix(docs, out_col="taken")
    assert {r["mix"] for r in named.select("mix").distinct().collect()} == {"old"}
    blobs = docs.select(F.col("text").cast("binary").alias("m.b"), F.lit("image/png").alias("declared"), F.lit(1).alias("true_type"), F.lit(2).alias("embedded"), "`a.b`")
    sniffed = media.sniff_column(blobs, "m.b")
    assert sniffed.columns.count("true_type") == sniffed.columns.count("embedded") == 1
    assert {r["true_type"] for r in sniffed.collect()} == {media.UNKNOWN}


def test_target_entropy(spark):
    """The least exponent of the grid at which the weights' entropy is at most the target."""
    tokens = {"a": 800, "b": 150, "c": 50}
    totals = spark.createDataFrame(list(tokens.items()), "key string, tokens long")

    def entropy(a):
        w = np.array([t**a for t in tokens.values()], float)
        w /= w.sum()
        return float(-(w * np.log(w)).sum())

    for target in (1.05, 0.6, 0.2):
        plan = mixing.mixture(totals, target_entropy=target).collect()
        a = plan[0]["exponent"]
        assert entropy(a) <= target + 1e-9 < entropy(a - 2e-6) + 1e-6
        assert abs(sum(r["weight"] for r in plan) - 1) < 1e-9


def test_media_validators_reject_broken_items():
    whole = [media.encode_media(bytes([k]) * 576 * 3) for k in range(40)]
    assert {kind for kind, _ in whole} == {"audio/wav", "image/bmp", "image/x-portable-graymap", "image/png"}
    for kind, blob in whole:
        assert media.sniff(blob)[0] == kind and media.decode_media(kind, blob) in [bytes([k]) * 576 * 3 for k in range(40)]
        assert media.sniff(blob[:-1])[0] == media.UNKNOWN
    png = next(b for k, b in whole if k == "image/png")
    assert media.sniff(png[:40] + b"\0" + png[41:])[0] == media.UNKNOWN


def test_inner_scores_never_see_held_out_labels(spark):
    """Turning the labels of the held-out fold around changes nothing; the inner fold alone is scored."""
    docs = spark.createDataFrame([(k, f"plain words number {k}. " + ("you vile rotten fool" if k % 3 == 0 else "a kind and calm day")) for k in range(150)], "doc_id long, text string")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(rest == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.inner_scores(docs, x).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]
    assert {r[0] for r in scores[0]} == {r[0] for r in docs.filter(rest == 1).collect()}
    assert brute.auc([r[1] for r in scores[0]], [r[2] for r in scores[0]]) == 1


def coded(rows, threshold=0.95):
    """What blocks of the second pass read of unit vectors, each a part of its own."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([rows.shape[1]] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["node", "dim", "unit"])
    (codes,) = vectors._code(4, 1)(iter([batch]))
    return [(node, node, signs, factor, scale, levels, error) for node, _, signs, factor, scale, levels, error in zip(*(c.to_pylist() for c in codes.columns), strict=True)]


@pytest.mark.parametrize("count", [1000, 4000])
def test_a_block_of_near_vectors_gives_a_forest(count):
    """A group with cosines around 0.93 in 64 dimensions: a block gives fewer links than vectors, few pairs that no bound decides, and the components of all links."""
    draw = np.random.default_rng(5)
    centre = draw.normal(size=64)
    rows = centre / np.linalg.norm(centre) + draw.normal(size=(count, 64)) * 0.0343
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    product = rows @ rows.T
    assert 0.92 < np.median(product) < 0.94
    linked = np.argwhere(np.triu(product >= 0.95, 1))
    assert len(linked) > 4 * count
    own = coded(rows)
    for halves in ([(own, None)], [(own[: count // 2], None), (own[count // 2 :], None), (own[: count // 2], own[count // 2 :])]):
        sure, left_open = (np.concatenate(x) for x in zip(*(pair for h in halves for pair in vectors.pairs_across(*h, 0.95)), strict=True))
        assert len(sure) < len(halves) * count and len(left_open) <= len(halves) * count // 10
        assert all(product[a, b] >= 0.95 for a, b in sure.tolist())
        kept = [*map(tuple, sure.tolist()), *((a, b) for a, b in left_open.tolist() if product[a, b] >= 0.95)]
        assert brute.components(list(range(count)), kept) == brute.components(list(range(count)), [tuple(x) for x in linked.tolist()])
