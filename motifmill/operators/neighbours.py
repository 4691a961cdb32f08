"""A graph of near neighbours by descent, and its fuzzy edge weights.

Rows are ordered by a few random projections; consecutive rows form blocks whose rows are compared
with each other, which gives the first neighbours.  Then, round after round, the
neighbours of neighbours are compared and the best ``k`` stay, until hardly any changes.  The rows
that share a near node m meet at m: their vectors are sent to m, once for each node, and
only pairs that reach the similarity which a row still keeps, and did not meet in an earlier round,
go on to a window over one row's candidates.  ``k`` forward and at most
``k`` reverse edges of a node (those with the least hash; of a hub not all) meet, so a
node has at most (2k)^2 candidates however often it is somebody's neighbour.

Weights: a row's nearest neighbour weighs 1, the others fall off at a scale that is found by
bisection so that all weights sum to log2(k); the two directions are united as a + b - ab.

Defined cases: null vectors are left out; keys are unique; fewer rows than ``k`` give fewer
neighbours; ties go to the smaller key; an empty table gives an empty graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.functions.vectors import EPSILON, normalise
from motifmill.scratch import written

#: Rows of a block in the first step, its projections, and the halvings of a bisection.
BLOCK, PROJECTIONS, HALVINGS = 64, 4, 40
#: Rows that a node is near to and that meet its candidates in one task, and what one product may differ from another.
TAKERS, SLACK = 1024, 1e-12


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _blocks(rows: DataFrame, k: int, seed: int, kind: str) -> DataFrame:
    """The best neighbours in blocks of consecutive rows in the order of a random projection."""
    sign = lambda i: F.when(F.pmod(F.xxhash64(F.lit(seed), i), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    place = F.aggregate(F.transform("v", lambda x, i: x * sign(i)), F.lit(0.0), lambda s, x: s + x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf])
            while len(kept) >= 2 * BLOCK:
                yield compared(kept.iloc[:BLOCK])
                kept = kept.iloc[BLOCK:]
        if kept is not None and len(kept):
            yield compared(kept)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        m, keys = np.stack(pdf["v"].to_list()), pdf["a"].to_numpy()
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        most = min(k, len(keys) - 1)
        best = np.argsort(-s, axis=1, kind="stable")[:, :most]
        return pd.DataFrame({"a": np.repeat(keys, most), "b": keys[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()})

    ordered = rows.withColumn("o", place).repartitionByRange("o", "a").sortWithinPartitions("o", "a").select("a", "v")
    return ordered.mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def _members(near: DataFrame, before: DataFrame | None) -> DataFrame:
    """(m, salt, x, late, out, takes): the rows that meet at each node, those that another takes as candidates first.

    ``out``: x is near m, a candidate for the rows that m is near to; ``takes``: m is near x.  A pair
    that met at m in an earlier round is not met again: rows stay away that no new edge brings
    a partner.  Nodes that are near very many rows have them dealt to several tasks.
    """
    edges = near.withColumn("now", F.lit(1))
    if before is not None:
        edges = edges.unionByName(before.withColumn("now", F.lit(0))).groupBy("a", "b").agg(F.max("now").alias("now"), F.count(F.lit(1)).alias("n"))
        edges = edges.where("now = 1").select("a", "b", (F.col("n") == 1).alias("new"))
    else:
        edges = edges.select("a", "b", F.lit(True).alias("new"))
    end = lambda m, x, old: edges.select(F.col(m).alias("m"), F.col(x).alias("x"), F.when(F.col("new"), 2 * old).otherwise(old).alias("flag"))
    met = end("a", "b", 1).unionByName(end("b", "a", 4)).repartition("m").groupBy("m", "x").agg(F.bit_or("flag").alias("flag"))
    has = lambda bits: F.col("flag").bitwiseAND(F.lit(bits)) != 0
    node = W.partitionBy("m")
    met = met.select("m", "x", has(3).alias("out"), has(12).alias("takes"), has(2).alias("out_new"), has(8).alias("takes_new"), F.bool_or(has(2)).over(node).alias("any_out"), F.bool_or(has(8)).over(node).alias("any_takes"), F.count_if(has(12)).over(node).alias("n"))
    met = met.withColumn("out", F.col("out") & (F.col("out_new") | F.col("any_takes"))).withColumn("takes", F.col("takes") & (F.col("takes_new") | F.col("any_out"))).where("out or takes")
    salts = F.ceil(F.col("n") / TAKERS).cast("bigint")
    own = F.when(F.col("out"), F.lit(0)).otherwise(F.pmod(F.xxhash64("x"), F.greatest(salts, F.lit(1))))
    # Candidates go to every task of a node, and take part as takers in the first.
    every = F.when(F.col("out") & (salts > 1), F.sequence(F.lit(0).cast("bigint"), salts - 1)).otherwise(F.array(own.cast("bigint")))
    return met.select("m", F.explode(every).alias("salt"), "x", "out", "takes", "out_new", "takes_new").withColumn("takes", F.col("takes") & (~F.col("out") | (F.col("salt") == 0)))


def _meet(members: DataFrame, rows: DataFrame, bars: DataFrame, k: int, kind: str) -> DataFrame:
    """(a, b, similarity) of the pairs that meet at a node and reach the least similarity that a still keeps.

    A row's vector is sent once for each node it meets at, not once for each candidate.
    """
    sent = members.join(rows.join(bars, "a", "left").select(F.col("a").alias("x"), "e", F.coalesce("bar", F.lit(-np.inf)).alias("bar")), "x")
    sent = sent.withColumn("late", ~F.col("out")).repartition("m", "salt").sortWithinPartitions("m", "salt", "late", "x")
    sent = sent.select("m", "salt", "x", "out", "takes", "out_new", "takes_new", "bar", "e")

    def pairs(held: tuple, lo: int, hi: int, cols: list, unit: np.ndarray, out: list) -> None:
        _, _, x, _, takes, _, takes_new, bar, _ = cols
        own = lo + np.flatnonzero(takes[lo:hi])
        if not len(own) or not len(held[0]):
            return
        s = unit[own] @ held[2].T
        wanted = (s >= bar[own][:, None] - SLACK) & (x[own][:, None] != held[0][None, :]) & (takes_new[own][:, None] | held[1][None, :])
        if s.shape[1] > k:
            least = np.partition(np.where(wanted, s, -np.inf), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            wanted &= s >= least[:, None] - SLACK  # ties all go on
        i, j = np.nonzero(wanted)
        out.append((x[own][i], held[0][j], s[i, j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held, of = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            done, held, of, out = cut(table, held, of, False)
            yield from sent_on(out)
            left = table.slice(done).to_batches()[0] if done < len(table) else None
        if left is not None:
            yield from sent_on(cut(pa.Table.from_batches([left]), held, of, True)[3])

    def cut(table: pa.Table, held, of, last: bool) -> tuple:
        """Goes through the nodes of a batch; one whose candidates may go on in the next batch is left for it."""
        cols = [c.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False) for c in table.columns[:8]] + [None]
        m, salt, x, is_out, _, out_new, _, _, _ = cols
        e = table.column("e").combine_chunks()
        unit = e.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1).astype(np.float64) if len(m) else np.zeros((0, 0))
        unit /= np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), EPSILON)
        at = np.flatnonzero((m[1:] != m[:-1]) | (salt[1:] != salt[:-1])) + 1
        starts = [0, *at.tolist(), len(m)]
        out: list = []
        for lo, hi in zip(starts, starts[1:]):
            if hi == lo:
                continue
            if of != (m[lo], salt[lo]):
                outs = int(is_out[lo:hi].sum())
                if hi == len(m) and outs == hi - lo and not last:
                    return lo, held, of, out
                of, held = (m[lo], salt[lo]), (x[lo : lo + outs], out_new[lo : lo + outs], unit[lo : lo + outs])
            pairs(held, lo, hi, cols, unit, out)
        return len(m), held, of, out

    def sent_on(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["a", "b", "similarity"])

    return sent.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def neighbours(df: DataFrame, k: int = 15, key: str = "vec_id", col: str = "embedding", seed: int = 42, rounds: int = 8, stop: float = 0.002) -> DataFrame:
    """(a, b, similarity): about the ``k`` rows with the greatest cosine for every row."""
    kind = df.schema[key].dataType.simpleString()
    e = F.col(col) if isinstance(df.schema[col].dataType.elementType, T.FloatType) else F.col(col).cast("array<double>")
    rows = written(df.where(F.col(col).isNotNull()).select(F.col(key).alias("a"), normalise(F.col(col)).alias("v"), e.alias("e")), "unit")
    start = None
    for p in range(PROJECTIONS):
        own = _blocks(rows, k, seed + p, kind)
        start = own if start is None else start.unionByName(own)
    vectors = rows.select("a", "e")
    graph = written(_best(start.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.lit(0).alias("born")), k), "neighbours")
    total, before = graph.count(), None
    for number in range(1, rounds + 1):
        back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"))
        drawn = F.row_number().over(W.partitionBy("a").orderBy(F.xxhash64(F.lit(seed), "a", "b")))
        back = back.withColumn("drawn", drawn).where(F.col("drawn") <= k).drop("drawn")
        near = written(graph.select("a", "b").unionByName(back).distinct(), "near")
        # The near rows are candidates themselves; those that are not neighbours yet were drawn from the other side.
        own = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity").join(near, ["a", "b"], "left_semi")
        bars = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("bar"))
        scored = _meet(_members(near, before), vectors, bars, k, kind).unionByName(own).withColumn("born", F.lit(number))
        # One exchange: by node, then the pairs and the ranks of a node.
        both = graph.unionByName(scored).repartition("a").groupBy("a", "b").agg(F.max(F.struct(-F.col("born"), "similarity")).alias("x"))
        after = written(_best(both.select("a", "b", F.col("x.similarity").alias("similarity"), (-F.col("x.col1")).alias("born")), k), "neighbours")
        changed = after.where(F.col("born") == number).count()
        graph, before = after, near
        if changed <= stop * max(1, total):
            break
    return graph.drop("born")


def falloff(distances: Column, target: float) -> Column:
    """The scale at which exp(-(d - least) / scale) sums to ``target`` over sorted distances, by bisection."""
    # Bound as lambda variables, so that neither the least nor a total is worked out again and again.
    def bound(shifted: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            total = F.aggregate(shifted, F.lit(0.0), lambda t, d: t + F.exp(-d / middle))
            halved = F.transform(F.array(total > target), lambda much: F.struct(F.when(much, s["low"]).otherwise(middle).alias("low"), F.when(much, middle).otherwise(s["high"]).alias("high")))
            return F.get(halved, F.lit(0))

        start = F.struct(F.lit(1e-6).alias("low"), F.lit(100.0).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda s: (s["low"] + s["high"]) / 2)

    shifted = F.transform(F.array(F.array_min(distances)), lambda least: F.transform(distances, lambda d: d - least))
    return F.get(F.transform(shifted, bound), F.lit(0))


def fuzzy_weights(graph: DataFrame, k: int) -> DataFrame:
    """(a, b, weight) of every edge in both directions, equal in both."""
    lists = graph.groupBy("a").agg(F.collect_list(F.struct("b", (1 - F.col("similarity")).alias("d"))).alias("near"))  # k of a node at most
    distances = F.transform("near", lambda x: x["d"])
    scaled = lists.withColumn("least", F.array_min(distances)).withColumn("scale", F.when(F.spark_partition_id() >= 0, falloff(distances, float(np.log2(k)))))
    directed = scaled.select("a", F.explode("near").alias("x"), "least", "scale").select("a", "x.b", F.exp(-(F.col("x.d") - F.col("least")) / F.col("scale")).alias("w"))
    both = directed.unionByName(directed.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    # One or two rows a pair: a + b - ab = 1 - (1 - a)(1 - b).
    return both.groupBy("a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("weight"))
