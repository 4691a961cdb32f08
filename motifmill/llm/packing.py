"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted, each with a cost.  Texts longer than the
largest are cut into pieces of that size.  Pieces go, longest first, into the open bin
with the least space that still holds them; if none does, a bin is opened whose size
has the least cost per token among those that hold the piece and are at most the
opening limit.  All permitted sizes are tried as that limit, every bin is at last
downsized to the cheapest size that holds its contents, and the plan of least total
cost stays: the sizes are optimised jointly.

Scale: only (id, length) are shuffled, never texts.  Rows of one id and length are counted
first and numbered from the count, ``RUN`` numbers to a task, so that a key of any size is
spread.  Pieces are dealt by a hash of id, length, number and piece into shards of about
``shard_pieces``, each packed alone, so a task's memory is bounded; the loss is at most the
partly filled bins of a shard (the README has a figure).

Defined cases: null and empty texts have only the end token; very long texts are cut into
pieces; ids are kept as they are, null ones too; ties are broken by id (null first), row
number and piece, so the plan does not depend on partitions; repeated rows are separate
items of one id; an empty table gives no bins; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.llm import common

#: Permitted lengths and their costs: the tokens, attention that grows with the square of the
#: length (as much as the tokens at 8192), and a fixed cost of each sequence.  Short sequences
#: pay for the fixed cost, long ones for attention, so each piece wants another size.
CAPACITIES = {c: c + c * c / 8192 + 128 for c in (512, 1024, 2048, 4096, 8192)}
SHARD_PIECES = 8192
#: Rows of one id and length that a task numbers.
RUN = 4096


def best_fit(lengths: list[int], capacities: Mapping[int, float], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit for lengths in descending order; bin of each, and capacity and contents of each bin.

    Bins are kept by space left; ``spaces`` is a bit set of the spaces that have a bin,
    so the tightest bin for a piece is the lowest bit at or above its length; of equal
    spaces the bin that was filled last is taken.
    """
    sizes = sorted(capacities)
    opens: dict[int, int] = {}
    by_space: dict[int, list[int]] = {}
    spaces, where, used, opened = 0, [], [], []
    for n in lengths:
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            bin_ = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            size = opens.get(n)
            if size is None:
                able = [c for c in sizes if n <= c <= max(limit, min(x for x in sizes if x >= n))]
                size = opens[n] = min(able, key=lambda c: (capacities[c] / c, c))
            bin_, space = len(used), size
            used.append(0)
            opened.append(size)
        used[bin_] += n
        left = space - n
        if left:
            by_space.setdefault(left, []).append(bin_)
            spaces |= 1 << left
        where.append(bin_)
    final = [min((c for c in sizes if c >= u), key=lambda c: (capacities[c], c)) for u in used]
    return where, final, used


def pack(lengths: list[int], capacities: Mapping[int, float]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest plan over all opening limits (ties: the larger limit)."""
    plans = [best_fit(lengths, capacities, limit) for limit in sorted(capacities, reverse=True)]
    return min(plans, key=lambda p: sum(capacities[c] for c in p[1]))


OUT = "bin_id bigint, bin_capacity bigint, bin_used bigint, bin_offset bigint, piece bigint, piece_start bigint, piece_length bigint"


def pack_lengths(items: DataFrame, capacities: Mapping[int, float] = CAPACITIES, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """One row per piece: its bin, the bin's final capacity and contents, its place in the bin and in its text."""
    top = max(capacities)
    spark = items.sparkSession
    scratch = common.Scratch(spark, "packing")
    base = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{length_col}`").cast("bigint").alias("n")).where("n > 0")
    base = base.groupBy("i", "n").agg(F.count(F.lit(1)).alias("rows")).withColumn("pieces", F.ceil(F.col("n") / F.lit(top)).cast("bigint"))
    base = scratch.write(base, "lengths")
    total = base.agg(F.sum(F.col("pieces") * F.col("rows"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_pieces))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    often = F.col("rows") > RUN
    runs = base.where(often).select("i", "n", "pieces", "rows", F.explode(F.sequence(zero, F.floor((F.col("rows") - 1) / RUN))).alias("run")).repartition("i", "n", "run")
    numbers = base.where(~often).select("i", "n", "pieces", F.explode(F.sequence(zero, F.col("rows") - 1)).alias("number"))
    many = runs.select("i", "n", "pieces", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + one) * RUN, F.col("rows")) - 1)).alias("number"))
    pieces = (
        numbers.unionByName(many)
        .select("i", "n", "number", F.explode(F.sequence(zero, F.col("pieces") - 1)).alias("p"))
        .withColumn("shard", F.pmod(F.xxhash64("i", "n", "number", "p"), F.lit(shards)).cast("bigint"))
        .select("i", "number", "p", (F.col("p") * top).alias("s"), F.least(F.lit(top).cast("bigint"), F.col("n") - F.col("p") * top).alias("n"), "shard")
    )
    id_type = items.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type)] + T.StructType.fromDDL(OUT).fields)
    costs = dict(capacities)

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [("n", "descending"), ("i", "ascending"), ("number", "ascending"), ("p", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        n = table.column("n").to_numpy()
        where, final, used = pack(n.tolist(), costs)
        bins = np.array(where, np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(n[order])
        starts = np.concatenate(([True], np.diff(bins[order]) > 0)) if len(bins) else np.zeros(0, bool)
        offset = np.empty(len(n), np.int64)
        before = ends - n[order]
        offset[order] = before - np.repeat(before[starts], np.diff(np.append(np.flatnonzero(starts), len(n))))
        new = [(key[0].as_py() << 32) + bins, np.array(final, np.int64)[bins], np.array(used, np.int64)[bins], offset]
        return pa.Table.from_arrays([table.column("i"), *map(pa.array, new), table.column("p"), table.column("s"), table.column("n")], out.names)

    return pieces.groupBy("shard").applyInArrow(packed, out)


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and one end token of each text (null: the end token alone)."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), (words + 1).cast("bigint").alias("n_tokens"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_lengths(word_lengths(common.table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of all documents."""
    return pack_lengths(word_lengths(docs))
