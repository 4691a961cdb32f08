"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers and documents are normalised alike (A-Z lower-cased,
ASCII punctuation and control characters turned into word breaks).  Every window
of ten consecutive item words becomes a pattern of one automaton over word numbers
(windows share the states of common beginnings); each text is scanned once and every
hit is mapped back to words and to code point offsets of the original text.

Scale: a map over the documents without a shuffle.  What is broadcast is the
benchmark text, whose size is checked first: above ``max_broadcast_bytes`` it is
refused, at every size below that one automaton is built, once in each Python worker.
It takes about 90 bytes of memory for a byte of benchmark text.  Only where
``block_bytes`` is given are the items dealt to several automata, each built once.

Defined cases: null or word-less text has no words and is never contaminated; an
empty table gives an empty result; very long texts are scanned whole; null or word-less
items have no windows; items of 1-9 words are one window; items of equal id count
once; an empty benchmark leaves every document clean; repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import common

WINDOW = 10

# One byte in, one byte out: offsets in the normalised text are offsets in the original.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Machine:
    """An automaton whose letters are numbers of item words; 0 is any other word."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for index, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in item_words(text)]
            n = min(window, len(words))
            for w in {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else ():
                owners.setdefault(w, []).append(index)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        same: dict[tuple, tuple] = {}  # windows of the same items share one value
        while owners:
            w, index = owners.popitem()
            value = (len(w), tuple(index))
            self.trie.add_word(w, same.setdefault(value, value))
        if len(self.trie):
            self.trie.make_automaton()

    def hits(self, words: list[bytes]):
        """(last word, words, items) of every occurrence of a window."""
        if not len(self.trie):
            return
        for last, (n, owners) in self.trie.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            yield last, n, owners


def _blocks(items: list[tuple[int, bytes]], block_bytes: int | None) -> list[list[tuple[int, bytes]]]:
    out: list[list[tuple[int, bytes]]] = [[]]
    size = 0
    for item in items:
        if block_bytes is not None and out[-1] and size + len(item[1]) > block_bytes:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def scan_text(text: bytes, machines: list[Machine]) -> tuple[int, int, set[int], list[tuple[int, int]]]:
    """Words, hit words, indexes of occurring items, spans of hit words as code point offsets."""
    flat = text.translate(_TABLE)
    words = flat.split()
    found: set[int] = set()
    edges = None
    for machine in machines if words else ():
        for last, n, owners in machine.hits(words):
            if edges is None:
                edges = np.zeros(len(words) + 1, np.int64)
            edges[last + 1 - n] += 1
            edges[last + 1] -= 1
            found.update(owners)
    if edges is None:
        return len(words), 0, found, []
    hit = np.cumsum(edges[:-1]) > 0
    raw = np.frombuffer(text, np.uint8)
    solid = np.concatenate(([0], (np.frombuffer(flat, np.uint8) != 32).astype(np.int8), [0]))
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, past = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    spans = [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(first, past)]
    return len(words), int(hit.sum()), found, spans


SCHEMA = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<first: bigint, past: bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int | None = None,
    max_broadcast_bytes: int = 8 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Words, hit words, occurring items (ids as sorted strings) and hit spans of each document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("binary").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > max_broadcast_bytes:
        raise ValueError(f"the benchmark has {size} bytes; scan it in parts of {max_broadcast_bytes}")
    rows = sorted(((r["id"] or "", bytes(r["t"])) for r in items.collect()))
    names = [r[0] for r in rows]
    # What a Python worker builds is kept in its copy of the broadcast value.
    sent = spark.sparkContext.broadcast({"ids": names, "blocks": _blocks([(i, t) for i, (_, t) in enumerate(rows)], block_bytes)})

    def worker():
        kept = sent.value
        if "machines" not in kept:
            kept["machines"] = [Machine(block, window) for block in kept["blocks"]]
        ids, machines = kept["ids"], kept["machines"]

        def work(texts: list[bytes]) -> list[pa.Array]:
            n, hits, found, spans = zip(*(scan_text(t, machines) for t in texts))
            listed = [sorted({ids[i] for i in f}) for f in found]
            return [
                pa.array(n, pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array(listed, pa.list_(pa.string())),
                pa.array([[{"first": a, "past": b} for a, b in s] for s in spans], _SPANS),
            ]

        return work

    return common.map_texts(docs, worker, SCHEMA, id_col, text_col, keep)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; the others go."""
    rows, names = common.hidden(docs)
    found = decontaminate(rows, common.table(spark, sf_dir, "benchmark"), id_col=names["doc_id"], text_col=names["text"], keep=common.others(names))
    return common.shown(found.where("n_hit = 0"), names)


# Words and windows of whole texts, in SQL: no automaton, a join of window strings.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
