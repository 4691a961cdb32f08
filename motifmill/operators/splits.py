"""Splits that keep groups whole, samples and shuffles, all by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifmill.operators.labels import draw
from motifmill.scratch import written

#: Characters of a hash that the first count goes by: 16 ** 4 counts come to the driver.
PREFIX = 4


def _share(size: float) -> float:
    if not 0 < size < 1:
        raise ValueError("the share lies between 0 and 1")
    return size


def _last(hashed: DataFrame, k: int, key: str) -> tuple[str, object] | None:
    """Hash and key of the ``k``-th row in hash order, of rows (h, key).

    Rows are counted by the beginning of their hash first; only those of the beginning that
    holds the k-th are ordered, so no task sees a share of the table.
    """
    start = F.substring("h", 1, PREFIX)
    before = 0
    for prefix, n in sorted(tuple(r) for r in hashed.groupBy(start.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if before + n >= k:
            own = hashed.where(start == prefix).orderBy("h", key).limit(k - before)
            return tuple(own.agg(F.max(F.struct("h", key)).alias("x")).first()["x"])
        before += n
    return None


def _first_in_hash_order(hashed: DataFrame, k: int, seed: int, key: str) -> Column:
    """Whether a row is among the first ``k``: told by its own hash, without a join."""
    last = _last(hashed, k, key) if k else None
    if last is None:
        return F.lit(False)
    h = draw(seed, F.col(key))
    return (h < F.lit(last[0])) | ((h == F.lit(last[0])) & (F.col(key) <= F.lit(last[1])))


def group_holdout(df: DataFrame, share: float = 0.2, seed: int = 42, group: str = "group") -> DataFrame:
    """Adds ``split``: the share of the *groups* (rounded up) in hash order are test."""
    hashed = written(df.select(group).distinct().select(draw(seed, F.col(group)).alias("h"), group), "groups")
    k = -int(-_share(share) * hashed.count() // 1)
    return df.withColumn("split", F.when(_first_in_hash_order(hashed, k, seed, group), "test").otherwise("train"))


def stratified_group_holdout(df: DataFrame, share: float = 0.2, seed: int = 42, group: str = "group", label: str = "label") -> DataFrame:
    """Adds ``split``: one fold of ``round(1 / share)``, dealt group by group within majority labels.

    Groups are ordered by size (large first) and hash within their majority label and
    dealt to the folds in turn, to and fro, which balances both sizes and labels without
    gathering groups on the driver.
    """
    folds = max(2, round(1 / _share(share)))
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(group).agg(F.sum("n").alias("size"), F.max(F.struct("n", label)).alias("main"))
    groups = groups.select(group, F.col("size"), F.col(f"main.{label}").alias("main"), draw(seed, F.col(group)).alias("h"))
    # Ranks by ranges: places in a range, and the groups of the label in the ranges before it.
    order = [F.col("size").desc(), F.col("h"), F.col(group)]
    ranged = groups.repartitionByRange("main", *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged.withColumn("place", F.row_number().over(W.partitionBy("part", "main").orderBy(*order)) - 1), "ranges")
    sizes = ranged.groupBy("main", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("main", "part", F.coalesce(F.sum("n").over(W.partitionBy("main").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    groups = ranged.join(F.broadcast(sizes), ["main", "part"])  # one row a range and label
    rank = F.col("before") + F.col("place")
    turn, place = F.floor(rank / folds), rank % folds
    fold = F.when(turn % 2 == 0, place).otherwise(folds - 1 - place)
    dealt = groups.select(group, F.when(fold == 0, "test").otherwise("train").alias("split"))
    return df.join(dealt, group).select(*df.columns, "split")


def group_folds(df: DataFrame, folds: int = 5, seed: int = 42, group: str = "group") -> DataFrame:
    """Adds ``fold``, the same for all rows of a group."""
    h = F.conv(F.substring(draw(seed, F.col(group)), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (h % folds).cast("int"))


def random_holdout(df: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """Adds ``split`` with exactly ``max(1, int(n * share))`` rows of validation (keys are unique)."""
    n = max(1, int(df.count() * _share(share)))
    hashed = df.select(draw(seed, F.col(key)).alias("h"), key)
    return df.withColumn("split", F.when(_first_in_hash_order(hashed, n, seed, key), "val").otherwise("train"))


def uniform_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows without replacement."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def epoch_order(df: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    return df.orderBy(draw(seed, F.lit(str(epoch)), F.col(key)), key)


def leaking_groups(df: DataFrame, group: str = "group") -> DataFrame:
    """Groups that occur on both sides of a split (there should be none)."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("sides")).where("sides > 1").select(group)
