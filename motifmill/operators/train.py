"""Masked-token training of the encoder in numpy, and evaluation of a model on masked tables.

The gradients are written out by hand and checked against differences in the tests.  Training
runs on the driver over a bounded sample of encoded rows (``max_rows``); evaluation maps over
a table of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from motifmill.operators import encoder
from motifmill.operators.encoder import EncoderConfig
from motifmill.operators.labels import draw
from motifmill.operators.masking import IGNORE, SpanMasker, span_mask
from motifmill.operators.metrics import schedule


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


# --- forward and backward ------------------------------------------------------


def _norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    centred = x - x.mean(axis=-1, keepdims=True)
    scale = 1 / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + 1e-5)
    unit = centred * scale
    return unit * w + b, (unit, scale)


class Gradients(dict):
    """Gradients by weight name, filled by the backward steps."""

    def linear(self, name: str, w: np.ndarray, x: np.ndarray, dy: np.ndarray) -> np.ndarray:
        rows = dy.reshape(-1, dy.shape[-1])
        self[name], self[f"{name}_b"] = rows.T @ x.reshape(-1, x.shape[-1]), rows.sum(axis=0)
        return dy @ w

    def norm(self, name: str, w: np.ndarray, kept: tuple, dy: np.ndarray) -> np.ndarray:
        unit, scale = kept
        flat = tuple(range(dy.ndim - 1))
        self[name], self[f"{name}_b"] = (dy * unit).sum(axis=flat), dy.sum(axis=flat)
        d = dy * w
        return scale * (d - d.mean(axis=-1, keepdims=True) - unit * (d * unit).mean(axis=-1, keepdims=True))


def loss_and_gradients(config: EncoderConfig, w: Mapping[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, backward: bool = True) -> tuple[float, np.ndarray, Gradients]:
    """Mean cross-entropy at labelled positions, the scores there, and the gradients of all weights."""
    b, n = ids.shape
    h, d = config.nhead, config.d_model
    size = d // h
    heads = lambda x: x.reshape(b, n, h, size).transpose(0, 2, 1, 3)
    merged = lambda x: x.transpose(0, 2, 1, 3).reshape(b, n, d)
    away = np.where(mask[:, None, None, :] == 1, 0.0, -1e9)
    x, kept = w["token"][ids] + w["position"][:n], []
    for k in range(config.num_encoder_layers):
        q, key, v = map(heads, np.split(x @ w[f"{k}.qkv"].T + w[f"{k}.qkv_b"], 3, axis=-1))
        s = q @ key.transpose(0, 1, 3, 2) / math.sqrt(size) + away
        s = np.exp(s - s.max(axis=-1, keepdims=True))
        s /= s.sum(axis=-1, keepdims=True)
        mixed = merged(s @ v)
        y, norm1 = _norm(x + mixed @ w[f"{k}.out"].T + w[f"{k}.out_b"], w[f"{k}.norm1"], w[f"{k}.norm1_b"])
        up = np.maximum(y @ w[f"{k}.up"].T + w[f"{k}.up_b"], 0)
        z, norm2 = _norm(y + up @ w[f"{k}.down"].T + w[f"{k}.down_b"], w[f"{k}.norm2"], w[f"{k}.norm2_b"])
        kept.append((x, q, key, v, s, mixed, y, norm1, up, norm2))
        x = z
    at = labels != IGNORE
    wanted, own = labels[at], x[at]
    inner = own @ w["head.in"].T + w["head.in_b"]
    share = 0.5 * (1 + _erf(inner / math.sqrt(2))) if inner.size else inner
    smooth, norm = _norm(inner * share, w["head.norm"], w["head.norm_b"])
    scores = smooth @ w["head.out"].T + w["head.out_b"]
    if not len(wanted):
        return 0.0, scores, Gradients()
    p = np.exp(scores - scores.max(axis=-1, keepdims=True))
    p /= p.sum(axis=-1, keepdims=True)
    rows = np.arange(len(wanted))
    loss = float(-np.log(p[rows, wanted] + 1e-12).mean())
    g = Gradients()
    if not backward:
        return loss, scores, g
    p[rows, wanted] -= 1
    back = g.norm("head.norm", w["head.norm"], norm, g.linear("head.out", w["head.out"], smooth, p / len(wanted)))
    back = g.linear("head.in", w["head.in"], own, back * (share + inner * np.exp(-0.5 * inner**2) / math.sqrt(2 * math.pi)))
    dx = np.zeros_like(x)
    dx[at] = back
    for k in reversed(range(config.num_encoder_layers)):
        x, q, key, v, s, mixed, y, norm1, up, norm2 = kept[k]
        dsum = g.norm(f"{k}.norm2", w[f"{k}.norm2"], norm2, dx)
        dy = dsum + g.linear(f"{k}.up", w[f"{k}.up"], y, g.linear(f"{k}.down", w[f"{k}.down"], up, dsum) * (up > 0))
        dsum = g.norm(f"{k}.norm1", w[f"{k}.norm1"], norm1, dy)
        dmixed = heads(g.linear(f"{k}.out", w[f"{k}.out"], mixed, dsum))
        ds = dmixed @ v.transpose(0, 1, 3, 2)
        ds = s * (ds - (ds * s).sum(axis=-1, keepdims=True)) / math.sqrt(size)
        parts = (ds @ key, ds.transpose(0, 1, 3, 2) @ q, s.transpose(0, 1, 3, 2) @ dmixed)
        dx = dsum + g.linear(f"{k}.qkv", w[f"{k}.qkv"], x, np.concatenate([merged(t) for t in parts], axis=-1))
    g["token"], g["position"] = np.zeros_like(w["token"]), np.zeros_like(w["position"])
    np.add.at(g["token"], ids, dx)
    g["token"][config.pad_id] = 0
    g["position"][:n] = dx.sum(axis=0)
    return loss, scores, g


# --- training ------------------------------------------------------------------


@dataclass
class Trainer:
    """Adam on spans masked anew in each epoch; the weights of the best epoch stay."""

    config: EncoderConfig
    masker: SpanMasker
    epochs: int = 3
    batch: int = 32
    rate: float = 1e-3
    warmup: int = 0
    clip: float = 1.0
    held_out: float = 0.1
    seed: int = 42
    history: list[dict] = field(default_factory=list)

    def prepared(self, rows: list[tuple]) -> list[tuple]:
        """Rows (key, ids, attention) as (attention, {epoch: (masked ids, labels)}), masked by Spark."""
        if not rows:
            return []
        spark = SparkSession.active()
        plain = [(k, str(key), [int(x) for x in ids], [int(x) for x in mask]) for k, (key, ids, mask) in enumerate(rows)]
        sample = spark.createDataFrame(plain, "place bigint, key string, input_ids array<bigint>, attention_mask array<bigint>")
        out = [(mask, {}) for *_, mask in plain]
        for epoch in range(self.epochs + 1):
            for r in span_mask(sample, self.masker, "key", self.seed, epoch).collect():
                out[r["place"]][1][epoch] = (r["input_ids"], r["labels"])
        return out

    @staticmethod
    def masked(rows: list[tuple], epoch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with masks, attention and labels of prepared rows."""
        return tuple(np.stack([np.asarray(x) for x in parts]) for parts in zip(*[(r[1][epoch][0], r[0], r[1][epoch][1]) for r in rows]))

    def fit(self, rows: list[tuple], weights: Mapping[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        rows = self.prepared(rows)
        w = {k: np.asarray(v, np.float64).copy() for k, v in (weights or encoder.random_weights(self.config, self.seed)).items()}
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(rows))
        kept_out = int(len(rows) * self.held_out)
        held, own = [rows[k] for k in order[:kept_out]], [rows[k] for k in order[kept_out:]]
        steps = self.epochs * math.ceil(len(own) / self.batch) + 2
        factors = [r["factor"] for r in schedule(SparkSession.active(), steps, self.warmup).orderBy("step").collect()]
        first, second, step, best = {}, {}, 0, None
        for epoch in range(1, self.epochs + 1):
            losses, turn = [], rng.permutation(len(own))
            for at in range(0, len(own), self.batch):
                ids, mask, labels = self.masked([own[k] for k in turn[at : at + self.batch]], epoch)
                loss, _, g = loss_and_gradients(self.config, w, ids, mask, labels)
                losses.append(loss)
                step += 1
                self._update(w, g, first, second, step, factors[step])
            row = {"epoch": epoch, "train_loss": float(np.mean(losses)) if losses else 0.0} | self.evaluate(w, held)
            self.history.append(row)
            if best is None or row["val_loss"] < best[0]:
                best = (row["val_loss"], {k: v.astype(np.float32) for k, v in w.items()})
        return best[1] if best else {k: v.astype(np.float32) for k, v in w.items()}

    def _update(self, w: dict, g: Gradients, first: dict, second: dict, step: int, factor: float) -> None:
        length = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, self.clip / (length + 1e-6))
        for name, x in g.items():
            x = x * shrink
            first[name] = 0.9 * first.get(name, 0.0) + 0.1 * x
            second[name] = 0.999 * second.get(name, 0.0) + 0.001 * x * x
            w[name] -= self.rate * factor * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)

    def evaluate(self, w: Mapping[str, np.ndarray], rows: list[tuple]) -> dict[str, float]:
        """Mean loss of batches and shares of hits on held-out rows, masked alike in all epochs."""
        losses, hits = [], []
        for at in range(0, len(rows), self.batch):
            ids, mask, labels = self.masked(rows[at : at + self.batch], 0)
            loss, scores, _ = loss_and_gradients(self.config, w, ids, mask, labels, backward=False)
            losses.append(loss)
            wanted = labels[labels != IGNORE]
            hits += [(x == five[0], x in five, x in self.masker.content_ids) for x, five in zip(wanted.tolist(), np.argsort(-scores, axis=1, kind="stable")[:, :5].tolist())]
        share = lambda k, rows: sum(r[k] for r in rows) / len(rows) if rows else 0.0
        content = [r for r in hits if r[2]]
        return {"val_loss": float(np.mean(losses)) if losses else 0.0, "top1": share(0, hits), "top5": share(1, hits), "content_top1": share(0, content), "content_top5": share(1, content)}


def train(rows: DataFrame, trainer: Trainer, key: str = "smarts", max_rows: int = 2000) -> dict[str, np.ndarray]:
    """Trains on the ``max_rows`` encoded rows that come first in hash order."""
    some = rows.orderBy(draw(trainer.seed, key), key).limit(max_rows).select(key, "input_ids", "attention_mask")
    return trainer.fit([(r[0], r[1], r[2]) for r in some.collect()])


def guesses(df: DataFrame, config: EncoderConfig, weights: Mapping[str, np.ndarray]) -> DataFrame:
    """Adds the five best ids at each labelled position (none elsewhere) of rows (input_ids, attention_mask, labels)."""
    sent = df.sparkSession.sparkContext.broadcast((config.to_dict(), dict(weights)))
    schema = T.StructType([*df.schema.fields, T.StructField("guesses", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, w = sent.value
        own = EncoderConfig(**values)
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                ids, mask, labels = (np.stack(part[c].to_list()) for c in ("input_ids", "attention_mask", "labels"))
                best = iter(np.argsort(-loss_and_gradients(own, w, ids, mask, labels, backward=False)[1], axis=1, kind="stable")[:, :5].tolist())
                out += [[next(best) if x != IGNORE else [] for x in row] for row in labels]
            yield pdf.assign(guesses=out)

    return df.mapInPandas(run, schema)
