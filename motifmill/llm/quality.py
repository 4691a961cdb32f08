"""Quality classifier: a factorisation machine trained with numpy.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
the sum-of-squares identity makes the pairwise part linear in the non-zeros.
Inputs are hashed words (log counts, unit length together), one-hot bins of
structure statistics, and metadata of the text itself (its length class).
Labels, language, source and ids are never inputs of a score.

Scale: training takes a bounded sample of labelled rows (``max_train`` rows, those
with the smallest hash of their id), whose whole texts become sparse counts and
statistics on the executors, as in scoring; only these come to the driver.  Scoring
is a map without a shuffle over all rows and whole texts, with a broadcast of fixed size (``buckets`` x (1 + rank) floats).

Defined cases: null and empty texts get the score of a text without words; rows
without a label or an id are scored and never trained on; without both classes in
the sample every score is the smoothed share of good labels; equal texts get equal
scores; of rows that share a labelled id the least text is trained on, all are scored; very
long texts are read whole; an empty table gives an empty result; extra columns are ignored
or, with ``keep``, passed through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import common
from motifmill.llm.features import TEXT_STATS, text_stats

THRESHOLD = 0.7
BINS = 8


@dataclass
class FactorisationMachine:
    buckets: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index, values, starts = encode(texts, self.buckets)
        return bins(index, values, starts, self.edges, self.buckets)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(forward(self.bias, self.linear, self.factors, *self.encode(texts))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def encode(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of all texts in one list, and the statistics of each (two-dimensional)."""
    index, values, sizes, stats = [], [], [], []
    mask, crc = buckets - 1, zlib.crc32
    for text in texts:
        words = text.split()
        counts = Counter(words)
        v = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        index.append(np.fromiter(map(crc, counts), np.int64, len(counts)) & mask)
        values.append(v / max(1e-9, float(np.sqrt((v * v).sum()))))
        sizes.append(len(counts))
        stats.append(text_stats(text, words, counts))
    return (np.concatenate(index), np.concatenate(values)), np.array(sizes), np.array(stats, np.float32)


def bins(words, sizes: np.ndarray, stats: np.ndarray, edges: np.ndarray, buckets: int):
    """Words and one-hot bins of the statistics as one sparse matrix (index, values, start of each row)."""
    n, m = stats.shape
    slots = np.stack([buckets + j * (BINS + 1) + np.searchsorted(edges[j], stats[:, j], side="right") for j in range(m)], axis=1)
    starts = np.concatenate(([0], np.cumsum(sizes + m)))
    index, values = np.empty(starts[-1], np.int64), np.full(starts[-1], 1.0, np.float32)
    is_word = np.ones(starts[-1], bool)
    at = (starts[1:, None] - m + np.arange(m)[None, :]).ravel()
    is_word[at] = False
    index[at] = slots.ravel()
    index[is_word], values[is_word] = words
    return index, values, starts


def forward(bias, linear, factors, index, values, starts):
    """Raw scores and the sums of the factors, needed again for gradients."""
    rows = starts[:-1]
    vx = factors[index] * values[:, None]
    sums = np.add.reduceat(vx, rows, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), rows)
    return bias + np.add.reduceat(linear[index] * values, rows) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def train(texts: list[bytes], labels: np.ndarray, buckets: int = 1 << 15, rank: int = 6, rate: float = 0.1, l2: float = 1e-5, batch: int = 64, steps: int = 1000, seed: int = 7) -> FactorisationMachine:
    return train_encoded(*encode(texts or [b""], buckets), labels, buckets, rank, rate, l2, batch, steps, seed)


def train_encoded(words: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, stats: np.ndarray, labels: np.ndarray, buckets: int = 1 << 15, rank: int = 6, rate: float = 0.1, l2: float = 1e-5, batch: int = 64, steps: int = 1000, seed: int = 7) -> FactorisationMachine:
    """Log loss by mini-batch AdaGrad; small samples are passed over more often (``steps`` batches at least)."""
    edges = np.stack([np.quantile(stats[:, j], np.linspace(0, 1, BINS + 2)[1:-1]) for j in range(stats.shape[1])]).astype(np.float32)
    size = buckets + len(TEXT_STATS) * (BINS + 1)
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    model = FactorisationMachine(buckets, float(np.log(prior / (1 - prior))), linear, factors, edges)
    if len(set(labels.tolist())) < 2:
        factors[:] = 0
        return model
    index, values, starts = bins(words, sizes, stats, edges, buckets)
    g_linear, g_factors, g_bias = np.full(size, 1e-4), np.full((size, rank), 1e-4), 1e-4
    epochs = max(6, min(100, steps * batch // len(labels)))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            cut = np.concatenate(([0], np.cumsum(starts[rows + 1] - starts[rows])))
            i, x = index[take], values[take]
            raw, sums = forward(model.bias, linear, factors, i, x, cut)
            error = ((sigmoid(raw) - labels[rows]) / len(rows)).astype(np.float32)
            each = np.repeat(error, np.diff(cut))
            own, inverse = np.unique(i, return_inverse=True)
            d_linear = np.bincount(inverse, each * x, len(own)) + l2 * linear[own]
            per = (each * x)[:, None] * (np.repeat(sums, np.diff(cut), axis=0) - factors[i] * x[:, None])
            d_factors = np.stack([np.bincount(inverse, per[:, f], len(own)) for f in range(rank)], axis=1) + l2 * factors[own]
            g_linear[own] += d_linear**2
            g_factors[own] += d_factors**2
            linear[own] -= (rate * d_linear / np.sqrt(g_linear[own])).astype(np.float32)
            factors[own] -= (rate * d_factors / np.sqrt(g_factors[own])).astype(np.float32)
            g_bias += error.sum() ** 2
            model.bias -= rate * float(error.sum()) / g_bias**0.5
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(common.crc_text(F.col(id_col)), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int, features: Callable[[list[bytes]], list[pa.Array]], schema: str, label_col: str = "quality") -> list:
    """Features and labels of a bounded sample of labelled training rows: those with the smallest hash of their id.

    ``features`` reads whole texts on the executors; only its columns come to the driver.
    """
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    got = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return sorted(common.map_texts(got, lambda: features, schema, keep=("label",)).collect(), key=lambda r: r["doc_id"])


def packed(texts: list[bytes], buckets: int) -> list[pa.Array]:
    """Hashed words, their values and the statistics of each text as bytes."""
    (index, values), sizes, stats = encode(texts, buckets)
    ends = np.cumsum(sizes)
    parts = [(index[e - n : e].astype(np.int32).tobytes(), values[e - n : e].tobytes(), x.tobytes()) for e, n, x in zip(ends, sizes, stats)]
    return [pa.array(list(c), pa.binary()) for c in zip(*parts)]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, buckets: int = 1 << 15) -> FactorisationMachine:
    rows = sample(docs, labels, max_train, lambda texts: packed(texts, buckets), "w binary, v binary, stats binary")
    if not rows:
        return train([], np.zeros(0), buckets)
    index, values = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("w", np.int32), ("v", np.float32)))
    sizes = np.array([len(r["w"]) // 4 for r in rows])
    stats = np.stack([np.frombuffer(r["stats"], np.float32) for r in rows])
    return train_encoded((index.astype(np.int64), values), sizes, stats, np.array([r["label"] for r in rows], np.float64), buckets)


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.buckets, model.bias, model.linear, model.factors, model.edges))

    def worker():
        machine = FactorisationMachine(*sent.value)

        def work(texts: list[bytes]) -> list[pa.Array]:
            out = [machine.score(texts[k : k + 256]) for k in range(0, len(texts), 256)]
            return [pa.array(np.concatenate(out).astype(np.float64), pa.float64())]

        return work

    return common.map_texts(docs, worker, "score double", id_col, text_col, keep)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the others go."""
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    rows, names = common.hidden(docs)
    scored = score(rows, model, names["doc_id"], names["text"], common.others(names))
    return common.shown(scored.where(F.col("score") >= THRESHOLD), names)
