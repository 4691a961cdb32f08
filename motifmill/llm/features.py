"""Statistics of texts and lines that the quality models share (UTF-8 bytes in)."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_PUNCT = b".,;:!?\"'()"

TEXT_STATS = ("log_words", "mean_word", "symbols", "upper", "digits", "punct", "distinct", "top_word", "dup_lines", "line_words", "bang", "pipes", "repeat_next", "sentence_ends")


def share(text: bytes, chars: bytes, total: int) -> float:
    return (len(text) - len(text.translate(None, chars))) / total if total else 0.0


def text_stats(text: bytes, words: list[bytes], counts: dict[bytes, int]) -> list[float]:
    """Structure statistics of a text; all are defined for an empty one."""
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n if n else 0.0,
        share(text, SYMBOLS, size),
        share(text, _UPPER, size),
        share(text, _DIGIT, size),
        share(text, _PUNCT, size),
        len(counts) / n if n else 1.0,
        max(counts.values()) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(n / len(lines))) if lines else 0.0,
        text.count(b"!") / n if n else 0.0,
        text.count(b"|") / n if n else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0,
        text.count(b".") / n if n else 0.0,
    ]


LINE_FEATURES = 20
#: Features of a line that occurred before in its text, and of noisy lines: many symbols,
#: mostly capitals, few distinct words, many bars or exclamation marks, words repeated at once.
REPEATED, NOISY = 11, [7, 10, 15, 16, 17, 19]


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Binary features of each line (rows) and its number of words."""
    out, sizes, seen = np.zeros((len(lines), LINE_FEATURES), np.float32), np.zeros(len(lines), np.int64), set()
    for k, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        sizes[k] = n
        row = out[k]
        row[0] = 1
        row[1 if n <= 2 else 2 if n <= 6 else 3 if n <= 20 else 4] = 1
        symbols, upper = share(line, SYMBOLS, size), share(line, _UPPER, size)
        row[5 if symbols == 0 else 6 if symbols < 0.05 else 7] = 1
        row[8 if upper < 0.08 else 9 if upper < 0.4 else 10] = 1
        row[11] = line in seen and n > 0
        row[12] = line.rstrip()[-1:] in (b".", b"!", b"?")
        distinct = len(set(words)) / n if n else 1.0
        row[13 if distinct > 0.7 else 14 if distinct > 0.3 else 15] = 1
        row[16] = line.count(b"|") > 2
        row[17] = line.count(b"!") > max(2, n // 3)
        row[18] = share(line, _DIGIT, size) > 0.15
        row[19] = n > 1 and sum(map(bytes.__eq__, words, words[1:])) > n // 4
        seen.add(line)
    return out, sizes
