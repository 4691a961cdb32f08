"""Exact top-k search by integer inner product, pruned block by block.

Rows are ordered by their strongest components and cut into blocks of consecutive rows
(document ranges).  A block keeps its rows' components (the forward index) and, for every
dimension (term), the largest and the smallest component.  For a query the sum of what each
dimension can give at most bounds every score of a block; blocks are visited by falling bound
until a bound is below the k-th best score so far, which no row of the blocks left can reach.
Each query starts with the k-th best score of its own block, known when that block is cut.

Scale: blocks are packed into shards and queries into packs, both of bounded bytes.  Shards and
packs meet in a grid: a shard is sent once for each pack and a pack once for each shard, all to
different tasks, so that no task holds more than one of each and nothing passes through the
driver but their counts.  A cell returns k rows a query at most, those that reach the query's
starting score; a window takes the best k of them.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled with zeros; an empty vector scores 0 with all; every row is a
candidate but the query's own, so rows with one key find each other; ties go to the smaller
key, a null key last; a null key is never a query unless ``query`` says so; scores beyond 64 bits stop at
their ends; an empty table gives no row; other columns are ignored.  The key is an
integer below 2^63 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifmill.llm import common

K = 10
#: Rows of a block.
BLOCK = 64
#: Most rows and components of a shard, and of a pack of queries.
SHARD_ROWS, SHARD_CELLS = 4096, 1 << 21
PACK_ROWS, PACK_CELLS = 512, 1 << 20
#: Strongest components that order the rows.
STRONGEST = 4
LOWEST, HIGHEST = -(2**63), 2**63 - 1

_PACKED = "is_pack boolean, at bigint, dims int, rids binary, ids binary, cells binary, high binary, low binary, floor binary"


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def strongest(vector: Column) -> Column:
    """The signed places of the largest components, which rows of one block should share."""
    ranked = F.array_sort(F.transform(vector, lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("a"), F.when(x < 0, -1 - i).otherwise(i + 1).alias("i"))))
    return F.transform(F.slice(ranked, 1, STRONGEST), lambda s: s["i"])


def _exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, as Python integers where 64 bits may not do."""
    d = min(q.shape[1], m.shape[1])
    q, m = q[:, :d], m[:, :d]
    if not d or not len(q) or not len(m):
        return np.zeros((len(q), len(m)), np.int64)
    most = d * max(int(q.max()), -int(q.min())) * max(int(m.max()), -int(m.min()))
    if most < 2**52:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    if most < 2**61:
        return q @ m.T
    return q.astype(object) @ m.T.astype(object)


def _held(scores: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(scores, LOWEST), HIGHEST).astype(np.int64) if scores.dtype == object else scores


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, held within 64 bits; the longer rows' ends meet zeros."""
    return _held(_exact(q, m))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a row of each block can score at most with each query."""
    return _held(_exact(np.maximum(q, 0), high) + _exact(np.minimum(q, 0), low))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score, then by id."""
    if len(scores) > 4 * k:
        reach = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= reach)
    else:
        near = np.arange(len(scores))
    return near[sorted(range(len(near)), key=lambda j: (-int(scores[near[j]]), ids[near[j]]))[:k]]


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, dims) if dims else np.zeros((0, 0), np.int64)


class _Cutter:
    """Cuts ordered rows into blocks, gathers the blocks into shards and the queries into packs."""

    def __init__(self, k: int):
        self.k, self.shard, self.pack, self.rows, self.at = k, [], [], [], 0

    def add(self, row: tuple[int, int | None, bool, list[int]]) -> Iterator[tuple]:
        self.rows.append(row)
        if len(self.rows) == BLOCK:
            yield from self.block()

    def block(self) -> Iterator[tuple]:
        if not self.rows:
            return
        dims = max(len(r[3]) for r in self.rows)
        m = np.zeros((len(self.rows), dims), np.int64)
        for j, r in enumerate(self.rows):
            m[j, : len(r[3])] = r[3]
        rids, ids = np.array([r[0] for r in self.rows], np.int64), np.array([HIGHEST if r[1] is None else r[1] for r in self.rows], np.int64)
        asked = [j for j, r in enumerate(self.rows) if r[2]]
        for j, scores in zip(asked, products(m[asked], m), strict=True):
            others = np.sort(np.delete(scores, j))[::-1]
            reach = int(others[self.k - 1]) if len(others) >= self.k else LOWEST
            self.pack.append((rids[j], ids[j], m[j], reach))
            if len(self.pack) == PACK_ROWS or len(self.pack) * dims >= PACK_CELLS:
                yield self.packed()
        self.shard.append((rids, ids, m))
        self.rows = []
        if len(self.shard) * BLOCK >= SHARD_ROWS or len(self.shard) * BLOCK * dims >= SHARD_CELLS:
            yield self.sharded()

    def sharded(self) -> tuple:
        blocks, self.shard, self.at = self.shard, [], self.at + 1
        dims = max(m.shape[1] for *_, m in blocks)
        wide = [np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for *_, m in blocks]
        high, low = (np.array([f(m, axis=0) for m in wide], np.int64) for f in (np.max, np.min))
        ids = [np.concatenate([b[j] for b in blocks]).tobytes() for j in (0, 1)]
        return (False, self.at, dims, *ids, np.concatenate(wide).tobytes(), high.tobytes(), low.tobytes(), None)

    def packed(self) -> tuple:
        rows, self.pack, self.at = self.pack, [], self.at + 1
        dims = max(len(r[2]) for r in rows)
        cells = np.array([np.pad(r[2], (0, dims - len(r[2]))) for r in rows], np.int64)
        columns = [np.array([r[j] for r in rows], np.int64).tobytes() for j in (0, 1, 3)]
        return (True, self.at, dims, columns[0], columns[1], cells.tobytes(), None, None, columns[2])

    def end(self) -> Iterator[tuple]:
        yield from self.block()
        if self.shard:
            yield self.sharded()
        if self.pack:
            yield self.packed()


def index(rows: DataFrame, query: Column, key: str, col: str, k: int, scale: int) -> DataFrame:
    """Shards of blocks and packs of queries, as rows of bounded size."""
    common.arrow_batches(rows.sparkSession)
    part = rows.where(usable(F.col(f"`{col}`"))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), integers(F.col(f"`{col}`"), scale).alias("v"), strongest(F.col(f"`{col}`")).alias("o")
    )
    part = part.repartitionByRange("o", "id", "rid").sortWithinPartitions("o", "id", "rid").select("rid", "id", "asks", "v")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(k)
        made: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(j).to_pylist() for j in range(4)], strict=True):
                made += cutter.add(row)
            yield from _rows(made)
            made = []
        made += cutter.end()
        yield from _rows(made)

    out = part.mapInArrow(cut, _PACKED)
    return out.withColumn("at", F.xxhash64(F.spark_partition_id(), "at"))


def _rows(made: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.bool_(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    names = [c.split()[0] for c in _PACKED.split(", ")]
    for row in made:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)


def visit(q: np.ndarray, rid: int, limits: np.ndarray, floor: int, cells: np.ndarray, rids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One query through the blocks of a shard, by falling bound: scores and ids of the best k that reach ``floor``, and the number of blocks scored."""
    order = np.argsort(limits, kind="stable")[::-1]  # the least of 64 bits has no negative
    scores, found, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 1
    while done < len(order):
        own = [b for b in order[done : done + step] if limits[b] >= floor]
        if not own:
            break
        done, step = done + len(own), step * 2
        at = np.concatenate([np.arange(b * BLOCK, min(len(cells), (b + 1) * BLOCK)) for b in own])
        at = at[rids[at] != rid]
        s = products(q[None], cells[at])[0]
        reach = s >= floor
        s, i = np.concatenate([scores, s[reach]]), np.concatenate([found, ids[at][reach]])
        keep = best(s, i, k)
        scores, found = s[keep], i[keep]
        if len(scores) == k:
            floor = max(floor, int(scores[-1]))
    return scores, found, done


def search(rows: DataFrame, query: Column, scratch: common.Scratch, k: int = K, key: str = "vec_id", col: str = "embedding", scale: int = 1024, report: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best ``k`` rows for every row that ``query`` holds for.

    With ``report`` one row for each query and shard instead: query_id, blocks and scored, the
    blocks there and those whose rows were scored.
    """
    made = scratch.write(index(rows, query, key, col, k, scale), "index")
    n_packs = made.where("is_pack").count()
    n_shards = made.count() - n_packs

    def cell(df: DataFrame, own: str, others: str, n_own: int, n_others: int, prefix: str) -> DataFrame:
        mine = F.pmod("at", F.lit(max(1, n_own))).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n_others - 1)).cast("bigint"))).alias(others)
        return df.select(mine, every, *[F.col(c).alias(f"{prefix}_{c}") for c in ("dims", "rids", "ids", "cells", "high", "low", "floor")])

    packs = cell(made.where("is_pack"), "p", "s", n_packs, n_shards, "q").drop("q_high", "q_low")
    shards = cell(made.where("not is_pack"), "s", "p", n_shards, n_packs, "d").drop("d_floor")
    met = packs.join(shards, ["p", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                r = batch.slice(j, 1).to_pylist()[0]
                q, cells, high, low = _matrix(r["q_cells"], r["q_dims"]), *[_matrix(r[f"d_{c}"], r["d_dims"]) for c in ("cells", "high", "low")]
                rid, qid, floor, rids, ids = [np.frombuffer(r[c], np.int64) for c in ("q_rids", "q_ids", "q_floor", "d_rids", "d_ids")]
                q = q if len(q) else np.zeros((len(rid), 0), np.int64)
                cells = cells if len(cells) else np.zeros((len(rids), 0), np.int64)
                n_blocks = -(-len(rids) // BLOCK)
                limits = bounds(q, high, low) if q.shape[1] and cells.shape[1] else np.zeros((len(q), n_blocks), np.int64)
                found = [visit(q[a], rid[a], limits[a], int(floor[a]), cells, rids, ids, k) for a in range(len(q))]
                if report:
                    out = [(qid[a], n_blocks, f[2]) for a, f in enumerate(found)]
                else:
                    out = [(rid[a], qid[a], i, s) for a, f in enumerate(found) for s, i in zip(f[0], f[1], strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in zip(*out, strict=True)], names=[f"c{j}" for j in range(len(out[0]))])

    if report:
        return met.mapInArrow(run, "c0 bigint, c1 bigint, c2 bigint").toDF("query_id", "blocks", "scored")
    near = met.mapInArrow(run, "c0 bigint, c1 bigint, c2 bigint, c3 bigint").toDF("rid", "query_id", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(HIGHEST)).alias(c)
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(known("query_id"), "rank", known("vec_id"), "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of ``embeddings`` for every row whose vec_id is divisible by 100."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, common.Scratch(spark, "topk"))


SQL = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
