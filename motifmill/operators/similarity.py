"""Cosine search, pairwise similarity, Tanimoto and correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifmill.functions.vectors import EPSILON, dot, normalise, tanimoto
from motifmill.scratch import written

#: Bytes of vectors of a block.
BLOCK_BYTES = 64 << 20
#: Similarities of one product, of a cell whose similarities are all returned, and of those sorted at once, at most.
PAIRS, CELL_PAIRS, SORTED = 1 << 20, 1 << 26, 1 << 24
#: Similarities that stay in a core's cache while they are rounded.
CACHED = 1 << 16
#: Token sets that are sent to all tasks at most.
MOST_QUERIES = 10_000


def normalised(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, normalise(F.col(col)))


def top_k(index: DataFrame, query: list[float], k: int = 10, key: str = "smarts", col: str = "embedding", exclude: str | int | None = None, digits: int = 4) -> DataFrame:
    """The ``k`` most similar rows: rank, similarity, key; ties by key; fewer rows than ``k`` are fine.

    The query is a literal in the plan; each task keeps its best ``k`` rows only.
    """
    q = np.asarray(query, np.float64)
    q = q / max(float(np.linalg.norm(q)), EPSILON)
    rows = index if exclude is None else index.where(F.col(key) != F.lit(exclude))
    scored = rows.select(F.col(key), dot(normalise(F.col(col)), F.array(*[F.lit(float(x)) for x in q])).alias("similarity"))
    best = scored.orderBy(F.col("similarity").desc(), key).limit(k)
    rank = F.row_number().over(W.orderBy(F.col("similarity").desc(), key))
    return best.select(rank.alias("rank"), F.round("similarity", digits).alias("similarity"), key)


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", col: str = "embedding", block: int = 512, exclude_self: bool = True) -> DataFrame:
    """The best ``k`` rows of the index for every query."""
    out = against(index, queries, k, key, col, block, exclude_self)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def against(index: DataFrame, queries: DataFrame, k: int | None = None, key: str = "vec_id", col: str = "embedding", block: int = 512, exclude_self: bool = True, block_bytes: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """The similarity of every query and every row of the index, by blocked matrix products; with ``k`` at least the best ``k``.

    Queries and index are dealt to blocks of about ``block_bytes`` of vectors, which meet in a
    grid.  A cell holds its block of queries; the rows of the index go past them batch by batch, and what
    ``block`` queries at most and a batch give, no more than ``PAIRS`` similarities, goes out at once,
    so that no task holds a cell's results.  Only three counts come to the driver.

    With ``digits`` (9 at most, without ``k``) similarities are rounded, halves away from zero, and leave sorted,
    ``SORTED`` at a time: equal ones stand together and keys come from a square of few queries and few
    rows, so that the result takes less than half the bytes where columns are stored.
    """
    if digits is not None and (k is not None or not 0 <= digits <= 9):
        raise ValueError("digits are 0 to 9 and go without k")
    kind, spark = index.schema[key].dataType.simpleString(), index.sparkSession
    known = lambda df: df.where(F.col(col).isNotNull()).select(key, col)
    index, queries = known(index), known(queries)
    n_rows, dims = index.agg(F.count(F.lit(1)), F.max(F.size(col))).first()
    most = max(1, block_bytes // (8 * (dims or 1)))
    n_queries = queries.count()
    down = max(1, -(-n_queries // most))
    across = max(1, -(-n_rows // most), -(-min(n_rows, spark.sparkContext.defaultParallelism) // down))
    if k is None:
        across = max(across, min(n_rows, -(-n_queries * n_rows // (down * CELL_PAIRS))))
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = queries.select(place(down).alias("x"), every(across).alias("y"), F.lit(False).alias("late"), F.col(key).alias("key"), F.col(col).alias("v"))
    r = index.select(every(down).alias("x"), place(across).alias("y"), F.lit(True).alias("late"), F.col(key).alias("key"), F.col(col).alias("v"))
    met = q.unionByName(r).repartitionById(down * across, (F.col("x") * across + F.col("y")).cast("int")).sortWithinPartitions("x", "y", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, parts, own, best, waiting = None, [], [], None, None, []
        for batch in batches:
            x, y, late, names = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            m = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPSILON)
            cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (late[1:] != late[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(x)]):
                if cell != (x[lo], y[lo]):
                    if waiting:
                        yield from ordered(own, asked, waiting)
                    waiting = []
                    cell, keys, parts, own, best = (x[lo], y[lo]), [], [], None, None
                if not late[lo]:
                    keys.append(names[lo:hi])
                    parts.append(m[lo:hi].copy())
                    continue
                if not keys:
                    continue
                if own is None:
                    own, asked, parts = np.concatenate(parts), np.concatenate(keys), []
                    best = np.full((len(own), k), -np.inf) if k is not None else None
                    high = min(most, max(1, SORTED // min(len(own), side)))
                if digits is not None:
                    while lo < hi:
                        right = min(hi, lo + high - sum(len(n) for _, n in waiting))
                        waiting.append((m[lo:right].copy(), names[lo:right]))
                        lo = right
                        if sum(len(n) for _, n in waiting) == high:
                            yield from ordered(own, asked, waiting)
                            waiting = []
                    continue
                wide = max(1, PAIRS // min(block, len(own)))
                for left in range(lo, hi, wide):
                    right = min(hi, left + wide)
                    for at in range(0, len(own), block):
                        out = product(own[at : at + block], asked[at : at + block], m[left:right], names[left:right], None if best is None else best[at : at + block])
                        if out.num_rows:
                            yield out
        if waiting:
            yield from ordered(own, asked, waiting)

    side = max(1, math.isqrt(SORTED))

    def ordered(own: np.ndarray, asked: np.ndarray, waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Rounded similarities from the least, each with its place in the square as one number."""
        rows, near = (np.concatenate(x) for x in zip(*waiting))
        for top in range(0, len(own), side):
            left, names = own[top : top + side], asked[top : top + side]
            both, n = np.empty(len(left) * len(near), np.int64), 0
            few = max(1, CACHED // len(near))
            for at in range(0, len(left), few):
                s = left[at : at + few] @ rows.T
                if exclude_self:
                    s[names[at : at + few, None] == near[None, :]] = -np.inf
                places = np.flatnonzero(np.isfinite(s))
                v = s.ravel()[places] * 10.0**digits
                whole = np.trunc(v)
                whole += np.copysign(np.abs(v - whole) >= 0.5, v)
                both[n : n + len(v)] = (whole.astype(np.int64) << 32) | (places + at * len(near))
                n += len(v)
            both = both[:n]
            both.sort()
            for at in range(0, n, PAIRS):
                a, b = np.divmod(both[at : at + PAIRS] & 0xFFFFFFFF, len(near))
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(near[b]), pa.array((both[at : at + PAIRS] >> 32) / 10.0**digits)], names=["query", "neighbour", "similarity"])

    def product(own: np.ndarray, asked: np.ndarray, rows: np.ndarray, near: np.ndarray, best: np.ndarray | None) -> pa.RecordBatch:
        s = own @ rows.T
        if exclude_self:
            s[asked[:, None] == near[None, :]] = -np.inf
        wanted = np.isfinite(s)
        if best is not None:
            # The best k so far, of this batch too; ties at the bar all go on.
            best[:] = -np.partition(-np.concatenate([best, np.where(wanted, s, -np.inf)], axis=1), k - 1, axis=1)[:, :k]
            wanted &= s >= best.min(axis=1)[:, None]
        a, b = np.nonzero(wanted)
        return pa.RecordBatch.from_arrays([pa.array(asked[a]), pa.array(near[b]), pa.array(s[a, b])], names=["query", "neighbour", "similarity"])

    return met.mapInArrow(run, f"query {kind}, neighbour {kind}, similarity double")


def pairs(sample: DataFrame, key: str, left: Column | None = None) -> DataFrame:
    """All pairs of a stated small sample, the lesser key first, as structs ``a`` and ``b``."""
    a = sample.select(F.struct("*").alias("a"))
    b = sample.select(F.struct("*").alias("b"))
    return a.join(b, F.col(f"a.{key}") < F.col(f"b.{key}"))


def pairwise_cosine(sample: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    unit = normalised(sample.select(key, col), col)
    return pairs(unit, key).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), dot(F.col(f"a.{col}"), F.col(f"b.{col}")).alias("similarity"))


def pairwise_tanimoto(sample: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Pairs with a defined similarity of their token sets."""
    return (
        pairs(sample.select(key, tokens), key)
        .select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), tanimoto(F.col(f"a.{tokens}"), F.col(f"b.{tokens}")).alias("similarity"))
        .where("similarity is not null")
    )


def tanimoto_against(index: DataFrame, queries: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """The defined similarities of a stated small set (``MOST_QUERIES`` rows at most) and every other row."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: take set_join")
    a = F.broadcast(queries.select(F.col(key).alias("a"), F.col(tokens).alias("ta")))
    b = index.select(F.col(key).alias("b"), F.col(tokens).alias("tb"))
    return b.join(a, F.col("a") != F.col("b")).select("a", "b", tanimoto(F.col("ta"), F.col("tb")).alias("similarity")).where("similarity is not null")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r, slope and intercept."""
    return df.agg(F.corr(x, y).alias("pearson"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks of values, the mean rank among equal ones.

    Distinct values are counted first; the running total goes by ranges of values, so no
    task sorts the whole column.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange(col).withColumn("_part", F.spark_partition_id()), "ranks")
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_t"))
    before = totals.select("_part", F.coalesce(F.sum("_t").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_part").orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("_in", inside).join(F.broadcast(before), "_part").select(col, (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, col)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"))
