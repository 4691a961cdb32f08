"""Quality rules with line labelling: a linear-chain CRF decoded by Viterbi.

Base rules are exact counts.  The method's verdict: every line of a text is marked
content or boilerplate by a two-state conditional random field, and a document is
kept if the words of its content lines are at least ``min_content`` of its words.
The field is trained here (maximum likelihood, forward-backward in numpy) on weak labels
of single lines (:func:`weak_labels`): lines that repeat, in their text or across texts of
the sample, and noisy lines are boilerplate in any document; the other lines of a good
document are content, and of a bad one too if it has noisy lines that explain its label.
The sample is bounded (``max_train`` labelled rows outside the held-out fold).

Scale: a map over the documents without a shuffle; the broadcast has a fixed size.

Defined cases: null text has no words; texts without words and texts under 20 words
fail the base rules; very long texts are decoded whole; blank lines are skipped by the
field; of equal paths content wins; without labelled rows the field keeps every line;
repeated rows give repeated results; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from motifmill.llm import common
from motifmill.llm.features import LINE_FEATURES, NOISY, REPEATED, SYMBOLS, line_features
from motifmill.llm.quality import sample

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MIN_CONTENT = 0.5


# --- base rules -------------------------------------------------------------


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the text (the first included)."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    level = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = level[: len(level) - step] * (int(level.max()) + 1) + level[step:]
        distinct, level = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
        length += step
    hit = np.bincount(level)[level] > 1
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = b"".join(words)
    chars = len(solid) if solid.isascii() else len(solid.decode())
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


# --- linear-chain CRF -------------------------------------------------------


@dataclass
class LineField:
    """Two states: 0 content, 1 boilerplate."""

    emission: np.ndarray  # (features, 2)
    transition: np.ndarray  # (2, 2)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        e = x @ self.emission
        n = len(e)
        if n == 0:
            return np.zeros(0, np.int8)
        (t00, t01), (t10, t11) = self.transition.tolist()
        back = bytearray(2 * n)
        a, b = map(float, e[0])
        for k, (ea, eb) in enumerate(e[1:].tolist(), 1):
            a, b, back[2 * k], back[2 * k + 1] = (
                max(a + t00, b + t10) + ea,
                max(a + t01, b + t11) + eb,
                b + t10 > a + t00,
                b + t11 > a + t01,
            )
        out, state = np.zeros(n, np.int8), int(b > a)
        for k in range(n - 1, -1, -1):
            out[k] = state
            state = back[2 * k + state]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(field: LineField, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
    """Mean log-likelihood and its gradients; x (sequences, lines, features), y and mask (sequences, lines)."""
    s, n, _ = x.shape
    e, t = (x @ field.emission) * mask[..., None], field.transition
    alpha, beta = np.zeros((s, n, 2)), np.zeros((s, n, 2))
    alpha[:, 0] = e[:, 0]
    for k in range(1, n):
        step = _lse(alpha[:, k - 1, :, None] + t[None], 1) + e[:, k]
        alpha[:, k] = np.where(mask[:, k, None] > 0, step, alpha[:, k - 1])
    for k in range(n - 2, -1, -1):
        step = _lse(t[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where(mask[:, k + 1, None] > 0, step, 0)
    z = _lse(alpha[:, -1], 1)
    marginal = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    truth = np.eye(2)[y] * mask[..., None]
    g_e = np.einsum("snf,snc->fc", x, truth - marginal)
    pair_mask = mask[:, 1:]
    pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_mask[..., None, None]
    seen = truth[:, :-1, :, None] * truth[:, 1:, None, :] * pair_mask[..., None, None]
    g_t = (seen - pair).sum(axis=(0, 1))
    fit = ((e * truth).sum() + (seen * t).sum() - z.sum()) / max(1, s)
    return fit, g_e / max(1, s), g_t / max(1, s)


def _by_length(pairs: list[tuple[np.ndarray, int | np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and masks of sequences, together where their lengths round up to one power of two."""
    alike: dict[int, list] = {}
    for pair in pairs:
        alike.setdefault((len(pair[0]) - 1).bit_length(), []).append(pair)
    out = []
    for _, own in sorted(alike.items()):
        n = max(len(rows) for rows, _ in own)
        x, y, mask = np.zeros((len(own), n, LINE_FEATURES)), np.zeros((len(own), n), np.int64), np.zeros((len(own), n))
        for k, (rows, label) in enumerate(own):
            x[k, : len(rows)], mask[k, : len(rows)], y[k, : len(rows)] = rows, 1, label  # of the text or of each line
        out.append((x, y, mask))
    return out


def train_field(sequences: list[np.ndarray], labels: list[int] | list[np.ndarray], steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> LineField:
    """Adam on the regularised likelihood of whole sequences, padded among those of like length only."""
    field = LineField(np.zeros((LINE_FEATURES, 2)), np.zeros((2, 2)))
    pairs = [(x, y) for x, y in zip(sequences, labels) if len(x)]
    if len(set().union(*(np.unique(y).tolist() for _, y in pairs))) < 2:
        field.emission[0, 0] = 1.0
        return field
    groups = _by_length(pairs)
    moments = [np.zeros_like(p) for p in (field.emission, field.transition) for _ in range(2)]
    for step in range(1, steps + 1):
        parts = [(len(x), *gradient(field, x, y, mask)[1:]) for x, y, mask in groups]
        g_e, g_t = (sum(p[0] * p[k] for p in parts) / len(pairs) for k in (1, 2))
        for k, (p, g) in enumerate(((field.emission, g_e), (field.transition, g_t))):
            g = g - l2 * p
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            p += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return field


def content_lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.split()]


def packed(texts: list[bytes]) -> list[pa.Array]:
    """The binary features of each text's lines as bits."""
    return [pa.array([np.packbits(line_features(content_lines(t))[0].astype(bool), axis=1).tobytes() for t in texts], pa.binary())]


def unpacked(lines: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(lines, np.uint8).reshape(-1, (LINE_FEATURES + 7) // 8), axis=1, count=LINE_FEATURES).astype(np.float32)


def line_hashes(texts: list[bytes]) -> pa.Array:
    """A 64-bit hash of each line of each text, in order."""
    import xxhash

    return pa.array([np.array([xxhash.xxh3_64_intdigest(x.strip()) for x in content_lines(t)], np.uint64).tobytes() for t in texts], pa.binary())


#: Texts of the sample that a line is in before it counts as repeated across texts.
SHARED = 3


def weak_labels(features: list[np.ndarray], hashes: list[np.ndarray], bad: list[int]) -> list[np.ndarray]:
    """1 for boilerplate lines, 0 for content.

    A line repeats across texts if ``SHARED`` texts of the sample hold it; where half of a
    text's lines do, the text is a copy of others, and its lines are not marked for that.
    """
    seen: dict[int, int] = {}
    for own in hashes:
        for h in set(own.tolist()):
            seen[h] = seen.get(h, 0) + 1
    out = []
    for x, own, is_bad in zip(features, hashes, bad):
        noisy = x[:, NOISY].any(axis=1)
        shared = np.array([seen[h] >= SHARED for h in own.tolist()], bool)
        marked = noisy | (x[:, REPEATED] > 0)
        if 2 * shared.sum() < len(shared):
            marked |= shared
        if is_bad and not noisy.any():
            marked[:] = True
        out.append(marked.astype(np.int64))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 1500) -> LineField:
    rows = sample(docs, labels, max_train, lambda texts: [*packed(texts), line_hashes(texts)], "lines binary, hashes binary")
    features, hashes = [unpacked(r["lines"]) for r in rows], [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    return train_field(features, weak_labels(features, hashes, [1 - int(r["label"]) for r in rows]))


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, n_content_words bigint"


def apply_rules(docs: DataFrame, field: LineField, min_content: float = MIN_CONTENT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((field.emission, field.transition))

    def worker():
        model = LineField(*sent.value)

        def work(texts: list[bytes]) -> list[pa.Array]:
            out = []
            for text in texts:
                counts = base_counts(text)
                failed = base_failed(counts[0], counts[4])
                x, sizes = line_features(content_lines(text))
                is_content = model.viterbi(x) == 0
                content = int(sizes[is_content].sum())
                out.append((*counts, failed, not failed and content >= min_content * counts[0], len(x), int(is_content.sum()), content))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3
            return [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]

        return work

    return common.map_texts(docs, worker, SCHEMA, id_col, text_col, keep)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, common.table(spark, sf_dir, "labels")))
