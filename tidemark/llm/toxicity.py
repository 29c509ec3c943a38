"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence's
probability is logistic in hashed words and word beginnings; the bag's is their
noisy-or, 1 - prod(1 - p). Only the bias may be negative: words give evidence of
toxicity or none, so that long sentences of clean words don't outweigh an offending one.
Training maximises the likelihood of the bags' labels by rounds: every partition takes
Adam steps on its own bags, starting from the common weights, and the partitions'
weights are averaged by their numbers of bags. Afterwards the sentence probabilities
tell which sentences offend.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, map_arrow, stash

#: The classifier is fitted on about this many labelled documents, picked by hash; scoring covers all.
TRAINING_DOCUMENTS = 12_000
SIZE = 1 << 18
STARTS = (4, 5)
ROUNDS, STEPS = 4, 12
#: Bags to a partition of the training.
PART_BAGS = 2_000
#: Step size, and the pull of every word's weight towards zero, in bags: chosen by inner_scores.
RATE, SHRINK = 0.3, 0.2
#: A clean sentence's log-odds before training: bags have tens of sentences, a tenth of them are toxic.
START_BIAS = -5.0
WORDS_KEPT = 400_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed ids of a word and of its beginnings."""
    forms = {word, *(f"{word[:n]}*" for n in STARTS if len(word) >= n)}
    return [zlib.crc32(x.encode()) % SIZE for x in forms]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Character spans between full stops, exclamation and question marks and line feeds; a text without any has none."""
    return [m.span() for m in _SENTENCE.finditer(text or "")]


BAG = "label int, features binary, sizes binary"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the feature ids of its sentences, joined, and how many each sentence has."""
    for batch in batches:
        feats, sizes = [], []
        for text in batch.column(1).to_pylist():
            lower = (text or "").lower()
            per = [[f for w in _WORD.findall(lower, a, b) for f in word_features(w)] for a, b in sentences(lower)]
            per = [x for x in per if x] or [[]]
            feats.append(np.array([f for x in per for f in x], "<i4").tobytes())
            sizes.append(np.array([len(x) for x in per], "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(feats, pa.binary()), pa.array(sizes, pa.binary())], names=["label", "features", "sizes"])


def noisy_or_gradient(w: np.ndarray, feats: np.ndarray, sentence_of: np.ndarray, bag_of: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Mean gradient of the bags' log-likelihood; the last weight is the bias."""
    z = np.bincount(sentence_of, w[feats], len(bag_of)) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = np.exp(np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)))
    pull = np.where(labels == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)
    g = p * pull[bag_of]
    grad = np.bincount(feats, g[sentence_of], len(w))
    grad[-1] = g.sum()
    return grad / len(labels)


def _train_part(weights: bytes, round_no: int, rate: float, shrink: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        w = np.frombuffer(weights, "<f8").copy()
        sizes = [np.frombuffer(r["sizes"], "<i4") for r in rows]
        feats = np.concatenate([np.frombuffer(r["features"], "<i4") for r in rows])
        bag_of = np.repeat(np.arange(len(rows)), [len(s) for s in sizes])
        sentence_of = np.repeat(np.arange(len(bag_of)), np.concatenate(sizes))
        labels = np.array([r["label"] for r in rows])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, STEPS + 1):
            g = noisy_or_gradient(w, feats, sentence_of, bag_of, labels)
            g[:-1] -= shrink / len(rows)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w += rate / (1 + round_no) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            np.maximum(w[:-1], 0, out=w[:-1])
        step = 1 << 14
        starts = range(0, len(w), step)
        yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([len(rows)] * len(starts), pa.int64()), pa.array([w[i : i + step].tobytes() for i in starts], pa.binary())], names=["start", "bags", "w"])

    return run


def _average(rows: pa.Table) -> pa.Table:
    n = np.array(rows["bags"].to_pylist(), float)
    w = np.stack([np.frombuffer(x, "<f8") for x in rows["w"].to_pylist()])
    return pa.table({"start": rows["start"][:1], "bags": pa.array([int(n.sum())], pa.int64()), "w": pa.array([(w * (n / n.sum())[:, None]).sum(0).tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str, training_documents: int = TRAINING_DOCUMENTS, rate: float = RATE, shrink: float = SHRINK) -> np.ndarray:
    """Weights from documents whose id has a label of 0 or 1 (the largest, if it has several).

    About training_documents of them are used, picked by a hash of the id. Without any,
    the weights stay as they start: every document then scores as clean.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    share = training_documents / max(1, known.count())
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1, share)))
    rows = docs.join(F.broadcast(picked), "doc_id").select("label", "text")  # bounded by training_documents
    bags = stash(map_arrow(rows, _bags, BAG), "bags")
    parts_wanted = max(1, -(-bags.count() // PART_BAGS))
    w = np.zeros(SIZE + 1)
    w[-1] = START_BIAS
    for k in range(ROUNDS):
        parts = map_arrow(bags.repartition(parts_wanted), _train_part(w.tobytes(), k, rate, shrink), "start long, bags long, w binary")
        for r in parts.groupBy("start").applyInArrow(_average, "start long, bags long, w binary").collect():  # the weights: 2 MB
            w[r["start"] : r["start"] + len(r["w"]) // 8] = np.frombuffer(r["w"], "<f8")
    return w


SCORES = "doc_id long, score double, offending array<struct<start: int, end: int, score: double>>"


def _score(w: np.ndarray, threshold: float):
    kept: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias = float(w[-1])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                lower = (text or "").lower()
                if len(lower) != len(text or ""):  # spans are those of the text itself
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                spans, z = sentences(lower), []
                for a, b in spans:
                    words = _WORD.findall(lower, a, b)
                    try:
                        z.append(bias + sum(map(kept.__getitem__, words)))
                    except KeyError:
                        if len(kept) > WORDS_KEPT:
                            kept.clear()
                        for x in words:
                            if x not in kept:
                                kept[x] = float(w[word_features(x)].sum())
                        z.append(bias + sum(map(kept.__getitem__, words)))
                p = 1 / (1 + np.exp(-np.clip(np.array(z or [bias]), -30, 30)))
                scores.append(float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
                found.append([{"start": a, "end": b, "score": float(x)} for (a, b), x in zip(spans, p, strict=False) if x >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "offending"])

    return run


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """Per document its score and the character spans of the sentences at or above the threshold.

    Null and empty texts score as one clean sentence and offend nowhere; rows that repeat
    an id are scored once each.
    """
    return map_arrow(docs.select("doc_id", "text"), _score(weights, threshold), SCORES)


def _remainder(doc_id, fold: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold


def inner_scores(docs: DataFrame, labels: DataFrame, *, fold: int = 5, held: int = 0, inner: int = 1, **how) -> DataFrame:
    """Scores of the labelled rows of one inner fold by a model of the other training rows: rate and shrink are chosen by them.

    Rows of the held-out fold are neither learned from nor scored. Returns doc_id, label and score.
    """
    docs, rest = documents(docs), _remainder(F.col("doc_id"), fold)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isin(0, 1) & (rest != held))
    weights = fit(docs, known.filter(rest != inner), label_col="toxic", **how)
    wanted = known.filter(rest == inner).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return score(docs.filter(rest == inner), weights).join(wanted, "doc_id").select("doc_id", "label", "score")


def toxicity(docs: DataFrame, labels: DataFrame, *, fold: int = 5, held: int = 0) -> DataFrame:
    """Trains on labelled rows outside the held-out fold, then scores every whole text.

    Returns doc_id, held_out, score, predicted and offending. Labels, languages, sources
    and ids are no inputs of a score.
    """
    docs = documents(docs)
    crc = lambda c: _remainder(c, fold) == held
    weights = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~crc(F.col("doc_id"))), label_col="toxic")
    return score(docs, weights).select(
        "doc_id", crc(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending"
    )
