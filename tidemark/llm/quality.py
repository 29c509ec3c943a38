"""Quality scores from document statistics.

Each whole text gives a vector of statistics (shares of characters, words and lines).
Random Fourier features of the standardised vector approximate a Gaussian kernel;
ridge regression on them is solved from normal equations that partitions sum up; a
monotone map, fitted by pooling adjacent violators over a histogram of held-back
predictions, turns the regression into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, map_arrow, stash

#: The fit uses about this many labelled documents, picked by hash; scoring covers all.
TRAINING_DOCUMENTS = 40_000
FEATURES, KERNEL_WIDTH, RIDGE, SEED = 256, 5.0, 1e-3, 17
#: Of the training documents, one in this many calibrates and doesn't fit.
CALIBRATE = 3
BINS, LOW, HIGH = 2000, -0.5, 1.5

_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def statistics(text: str | None) -> list[float]:
    """Numbers that don't depend on the language; zeros for an empty text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * STATISTICS
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    space = count[[9, 10, 11, 12, 13, 32]].sum()
    symbols = count[list(_SYMBOLS)]
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    return [
        np.log1p(n), np.log1p(len(words)), upper / n, lower / n, digit / n, space / n, count[128:].sum() / n, count[:32].sum() / n,
        symbols.sum() / n, symbols.max() / n, *np.sqrt(symbols[[0, 3, 4, 5, 10, 29]] / n), (symbols[[10, 12]].sum()) / w,
        lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(), distinct / w, np.log1p(w / max(1, distinct)),
        np.log1p(n / m), len(set(lines)) / m, sum(x.isupper() for x in words) / w, sum(x[:1].isupper() for x in words) / w, upper / max(1, upper + lower),
    ]


STATISTICS = 0
STATISTICS = len(statistics("x"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.array(statistics(t), "<f8").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["doc_id", "x"])


class Fourier:
    """cos(Wx + b) of the standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        r = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w, self.b = r.normal(0, 1 / KERNEL_WIDTH, (STATISTICS, FEATURES)), r.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("x")).to_pylist()), "<f8").reshape(-1, STATISTICS)


def _sum_rows(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f8") for x in rows["v"].to_pylist())
    return pa.table({"i": rows["i"][:1], "v": pa.array([total.tobytes()], pa.binary())})


def _summed(df: DataFrame, rows_of) -> dict[int, np.ndarray]:
    """Sums, over all partitions, of the fixed number of vectors that rows_of makes of each batch's statistics and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = rows_of(_vectors(batch), np.array(batch.column(batch.schema.get_field_index("label")).to_pylist(), float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "v"])

    summed = map_arrow(df.select("x", "label"), run, "i int, v binary").groupBy("i").applyInArrow(_sum_rows, "i int, v binary")
    return {r["i"]: np.frombuffer(r["v"], "<f8") for r in summed.collect()}  # FEATURES + 2 rows at most


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: centres and means of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, weight, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Random features, ridge coefficients and the calibration's knots; scores 0.5 everywhere if nothing was learnt."""

    def __init__(self, fourier: Fourier | None, beta: np.ndarray | None):
        self.fourier, self.beta = fourier, beta
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.beta, LOW, HIGH) if self.fourier else np.full(len(x), 0.5)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.x, self.y), 0, 1)


def fit(measured: DataFrame, labels: DataFrame, *, label_col: str, training_documents: int = TRAINING_DOCUMENTS) -> Model:
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    share = training_documents / max(1, known.count())
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1, share)))
    rows = stash(measured.join(picked, "doc_id").withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0), "quality-training")
    fitting = rows.filter("not calibrate")
    moments = _summed(fitting, lambda x, y: np.stack([x.sum(0), (x * x).sum(0), np.full(STATISTICS, float(len(x)))]))
    if not moments:
        return Model(None, None)
    n = moments[2][0]
    mean = moments[0] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 1e-12)) + 1e-6)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x)
        return np.vstack([z.T @ z, z.T @ y])

    sums = _summed(fitting, equations)
    a, b = np.stack([sums[i] for i in range(FEATURES + 1)]), sums[FEATURES + 1]
    penalty = RIDGE * n / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model = Model(fourier, np.linalg.solve(a + penalty + 1e-9 * np.eye(FEATURES + 1), b))

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = model.raw(x)
        at = np.minimum(((p - LOW) / (HIGH - LOW) * BINS).astype(int), BINS - 1)
        return np.stack([np.bincount(at, v, BINS) for v in (np.ones(len(p)), p, y)])

    bins = _summed(rows.filter("calibrate"), histogram)
    if bins:
        used = bins[0] > 0
        model.x, model.y = pool_adjacent(bins[1][used] / bins[0][used], bins[2][used] / bins[0][used], bins[0][used])
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(_vectors(batch)), pa.float64())], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, *, fold: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Trains on labelled rows outside the held-out fold, then scores every whole text.

    Returns doc_id, held_out, score and predicted (score at or above the threshold). Null
    and empty texts have statistics of zero and are scored by them. Rows that repeat an id
    are scored once each; a label counts once an id, the largest if there are several.
    Without training rows every score is 0.5. Labels, languages, sources and ids are no
    inputs of a score.
    """
    crc = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % fold == held
    measured = stash(map_arrow(documents(docs), _measure, "doc_id long, x binary"), "statistics")
    model = fit(measured, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~crc(F.col("doc_id"))), label_col="quality")
    scored = map_arrow(measured, _score(model), "doc_id long, score double")
    return scored.select("doc_id", crc(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
