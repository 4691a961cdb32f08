"""Substring dedup by level-wise doubling.

A word goes if a window of ``min_words`` words covers it whose word sequence starts
somewhere else too, in the same text or another.  Windows are found level by level
(:func:`levels`): short windows first, then, of the places that are repeated and of them
alone, windows of twice the length (the last words of both halves may overlap by one), until
the wanted length is reached or no candidate survives.

A level need not count every short window: each window of the wanted length names the
short window inside it with the least hash (the leftmost of equal ones).  Equal windows
name equal ones at equal places, so counting the named windows alone loses nothing.  A place
survives a level if its named window is repeated; at the last level a window names itself,
and is counted under two independent 64-bit hashes of its words.

Whole texts that are copies are found first, by a 128-bit hash: all their windows are
repeated.  One copy of each group takes part in the levels, so that other texts still
meet its windows; groups of copies of any size cost one row per copy.

Scale: the first level keeps one row for each text, its named windows' hashes and
places as lists; rows of copies leave before any window is counted.  Every level is
a partially aggregated count of hashes, written to shared scratch, and a join of the level's
windows with the repeated hashes that adaptive execution can split where a passage is in
very many texts.  All texts are shuffled twice, by row key, for the candidates of the first
level and for the removal; each level between shuffles the candidates' texts.

Defined cases: null and empty texts have no words; texts shorter than the window keep
all words; very long texts enter whole; of equal least hashes the leftmost counts; repeated rows (equal id and text) are copies of each other and both lose
their windows; an empty table gives an empty result; extra columns are ignored or, with
``keep``, passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import common

MIN_WORDS = 35
#: The first level has at most this many words: 35 words take the levels 9, 18 and 35.
FIRST_LEVEL = 10
_BASE, _BASE_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WindowHashes:
    """Hashes of all windows of a text by differences of prefix sums (modulo 2**64)."""

    def __init__(self, digest: Callable[[bytes], int] | None = None) -> None:
        self.words = common.WordHashes(digest=digest)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE_INVERSE))), dtype=np.uint64)

    def prefix(self, words: list[bytes] | np.ndarray) -> np.ndarray:
        h = common.mix(self.words(words)) if isinstance(words, list) else words
        if len(h) > len(self.up) - 1:
            self._grow(2 * len(h))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)], dtype=np.uint64)))

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        n = len(prefix) - length
        return common.mix((prefix[length:] - prefix[:n]) * self.down[:n])


def named_windows(half: np.ndarray, spread: int) -> np.ndarray:
    """For each long window, the place of the least (leftmost) of its ``spread`` half windows."""
    view = np.lib.stride_tricks.sliding_window_view(half, spread)
    return np.arange(len(view)) + view.argmin(axis=1)


def levels(min_words: int, first: int = FIRST_LEVEL) -> list[int]:
    """Window lengths, each at most twice the one before."""
    out = [min_words]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def surviving(hashes: WindowHashes, words: list[bytes], min_words: int, lengths: list[int], repeated: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places whose named windows were repeated at all levels but the last, and their windows' hashes at that one.

    ``lengths`` are the levels so far; returned are the distinct places that the surviving
    windows name at the last of them, and all window hashes of that length.
    """
    prefix = hashes.prefix(words)
    alive = np.ones(len(prefix) - min_words, bool)
    for length, at in zip(lengths, [*repeated, None]):
        own = hashes.windows(prefix, length)
        named = named_windows(own, min_words - length + 1)
        if at is not None:
            alive &= np.isin(named, np.array(at, np.int64))
    return np.unique(named[alive]), own


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    """A 128-bit key of the row and one of the text."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return {"k1": F.xxhash64(i, t), "k2": F.xxhash64(t, i, F.lit(7)), "t1": F.xxhash64(t), "t2": F.xxhash64(F.lit(7), t)}


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def _flush(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)


def _emit(rows: Iterator[list[np.ndarray]], names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for part in rows:
        parts.append(part)
        size += len(part[0])
        if size >= most:
            yield _flush(parts, names)
            parts, size = [], 0
    if parts:
        yield _flush(parts, names)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def repeated_starts(docs: DataFrame, min_words: int, scratch: common.Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row keys with the starts of repeated windows, and whether the whole text is a copy."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = docs.select(*[c.alias(k) for k, c in _keys(id_col, text_col).items()], F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")

    # Level 0: whole texts.
    keys = scratch.write(rows.select("k1", "k2", "t1", "t2"), "keys")
    copied = keys.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2")).alias("first")).where("n > 1")
    copied = scratch.write(copied.select("t1", "t2", "first"), "copied")
    copies = scratch.write(keys.join(copied, ["t1", "t2"]).select("k1", "k2", (F.struct("k1", "k2") == F.col("first")).alias("leads")).groupBy("k1", "k2").agg(F.max("leads").alias("leads")), "copies")
    scratch.drop("keys")

    def listed(length: int) -> Callable:
        """The windows of one length that a text names, as a row for each text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WindowHashes()
            for batch in batches:
                for part in common.slices(batch, 2):
                    keys, gs, ps = [], [], []
                    for k, text in enumerate(part.column(2).to_pylist()):
                        words = text.split()
                        if len(words) >= min_words:
                            at, own = surviving(hashes, words, min_words, [length], [])
                            keys.append(k)
                            gs.append(own[at].view(np.int64))
                            ps.append(at.astype(np.int32))
                    if keys:
                        own = part.take(pa.array(keys))
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _lists(gs, pa.int64()), _lists(ps, pa.int32())], names=["k1", "k2", "g", "p"])

        return run

    def counted(lengths: list[int], exact: bool) -> Callable:
        """Hashes and places of the windows named at the last of these levels."""
        names = ["g", "k1", "k2", "p"] + ["h"] * exact

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            hashes = WindowHashes()
            second = WindowHashes(xxhash.xxh64_intdigest) if exact else None

            def named() -> Iterator[list[np.ndarray]]:
                for batch in batches:
                    for part in common.slices(batch, 2):
                        for k1, k2, text, *repeated in zip(*(c.to_pylist() for c in part.columns)):
                            words = text.split()
                            if len(words) < min_words:
                                continue
                            at, own = surviving(hashes, words, min_words, lengths, repeated)
                            out = [own[at].view(np.int64), np.full(len(at), k1), np.full(len(at), k2), at.astype(np.int32)]
                            if exact:
                                out.append(second.windows(second.prefix(words), min_words)[at].view(np.int64))
                            yield out

            yield from _emit(named(), names)

        return run

    lengths = levels(min_words)
    place = "g bigint, k1 bigint, k2 bigint, p int"
    candidates = rows.select("k1", "k2", "t")
    for k in range(len(lengths) - 1):
        if k == 0:  # of equal texts only the first takes part, of equal rows one
            each = candidates.mapInArrow(listed(lengths[0]), "k1 bigint, k2 bigint, g array<bigint>, p array<int>")
            each = each.groupBy("k1", "k2").agg(F.any_value(F.struct("g", "p")).alias("x"))
            each = scratch.write(each.join(copies.where("not leads"), ["k1", "k2"], "left_anti").select("k1", "k2", "x.g", "x.p"), "level0")
            level = each.select("k1", "k2", F.explode(F.arrays_zip("g", "p")).alias("x")).select("x.g", "k1", "k2", "x.p")
        else:
            level = scratch.write(candidates.mapInArrow(counted(lengths[: k + 1], False), place), f"level{k}")
        again = scratch.write(_repeated(level, ["g"]), f"repeated{k}")
        found = level.join(again, "g").groupBy("k1", "k2").agg(F.collect_set("p").alias(f"at{k}"))
        if k == 0:
            candidates = candidates.join(common.shuffled(scratch.write(found, "found0")), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        else:
            candidates = candidates.join(common.shuffled(found), ["k1", "k2"])
        candidates = scratch.write(candidates, f"candidates{k}")
        scratch.drop(f"level{k}", f"repeated{k}", f"found{k}", f"candidates{k - 1}")
        if candidates.isEmpty():
            break
    level = scratch.write(candidates.mapInArrow(counted(lengths, True), f"{place}, h bigint"), "last")
    if len(lengths) == 1:  # there was no level to leave the copies out
        level = level.join(copies, ["k1", "k2"], "left").where("leads is null or leads").dropDuplicates(["k1", "k2", "p"])
    again = scratch.write(_repeated(level, ["g", "h"]), "repeated")
    starts = level.join(again, ["g", "h"]).groupBy("k1", "k2").agg(F.collect_list("p").alias("starts"))
    starts = starts.join(copies.select("k1", "k2", F.lit(True).alias("copy")), ["k1", "k2"], "full")
    out = scratch.write(starts, "starts")
    scratch.drop(f"candidates{len(lengths) - 2}", "last", "repeated", "copies", "copied")
    return out


def remove(words: list[bytes], starts: list[int] | None, whole: bool, min_words: int) -> list[bytes]:
    """The words that no repeated window covers."""
    n = len(words)
    if whole and n >= min_words:
        return []
    if not starts:
        return words
    edges = np.zeros(n + 1, np.int64)
    at = np.array(starts)
    edges[at] += 1
    edges[at + min_words] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's words, removed words and kept text (kept words joined by one space)."""
    if min_words < 2:
        raise ValueError("min_words is at least 2")
    scratch = common.Scratch(docs.sparkSession, "substring_dedup")
    starts = repeated_starts(docs, min_words, scratch, id_col, text_col)
    kept = [id_col, *keep]
    keys = _keys(id_col, text_col)
    left = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(f"`{text_col}`").cast("binary").alias("t"), keys["k1"].alias("k1"), keys["k2"].alias("k2"))
    joined = left.join(common.shuffled(starts), ["k1", "k2"], "left")
    schema = "n_words bigint, n_removed bigint, kept_text string"
    out = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), schema])
    width = len(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, texts = [], [], []
            for text, at, copy in zip(*(batch.column(width + k).to_pylist() for k in range(3))):
                words = (text or b"").split()
                left = remove(words, at, bool(copy), min_words)
                n.append(len(words))
                gone.append(len(words) - len(left))
                texts.append(b" ".join(left).decode("utf-8", "replace"))
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(width)] + new, [*kept, "n_words", "n_removed", "kept_text"])

    return joined.select(*[f"c{k}" for k in range(width)], "t", "starts", "copy").mapInArrow(cut, out)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages (what is left joined by single spaces).

    Texts that lose nothing stay as they are; documents that had words and lose all of
    them go.
    """
    rows, names = common.hidden(docs)
    out = substring_dedup(rows, id_col=names["doc_id"], text_col=names["text"], keep=common.others(names))
    out = out.where("n_removed = 0 or n_removed < n_words")
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    cut = lambda c: F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col(names[c])) if c in changed else F.col(names[c])
    return out.select(*[cut(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM
  (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.p = x.p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
