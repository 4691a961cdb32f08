"""Enzyme-class labels: label join, rare classes, stratified sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions.ec import primary_ec
from motifmill.functions.text import is_true
from motifmill.operators.clean import keep_first
from motifmill.scratch import written


def label_map(raw: DataFrame, depth: int = 1) -> DataFrame:
    """The label of each template: that of its first valid row that has one."""
    rows = raw.where(is_true(F.col("VALID")))
    rows = rows.select("ord", F.col("TEMPLATE").alias("smarts"), primary_ec(F.col("ECS"), depth).alias("label"))
    return keep_first(rows.where("label is not null and smarts is not null"), "smarts").select("smarts", "label")


def contenders(raw: DataFrame, prefix: str) -> DataFrame:
    """The rows that may be the first valid or the first labelled one of their template, and few others.

    ``prefix`` names a number by which ``ord`` is sorted first.  Its minima are found by hashing, without
    sorting the rows; groups and labels of the rows kept are those of all rows.
    """
    rows = raw.where(is_true(F.col("VALID")) & F.col("TEMPLATE").isNotNull()).withColumn("_p", F.col(prefix))
    labelled = primary_ec(F.col("ECS")).isNotNull()
    least = rows.groupBy("TEMPLATE").agg(F.min("_p").alias("_first"), F.min(F.when(labelled, F.col("_p"))).alias("_label"))
    least = written(least, "least")  # its size is known then, and a small one is broadcast
    may = F.col("_p").isNull() | (F.col("_p") == F.col("_first")) | F.coalesce(F.col("_p") == F.col("_label"), F.lit(False))
    return written(rows.join(least, "TEMPLATE").where(may).select(raw.columns), "contenders")


def join_labels(validated: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with a label (repeated rows stay), and their group (their own text if none)."""
    group = F.coalesce("reaction_group", "smarts") if "reaction_group" in validated.columns else F.col("smarts")
    return validated.join(labels, "smarts").select("smarts", "label", group.alias("group"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def min_class_count(rows: int, n_samples: int | None) -> int:
    """Rows that a class needs to survive sampling and stratified splits."""
    return max(10, int(n_samples / rows * 10) + 2) if n_samples and rows else 10


def drop_rare(df: DataFrame, min_count: int, label: str = "label") -> DataFrame:
    """Rows of classes with ``min_count`` rows or more (the class table is small, the rows are not shuffled for it)."""
    common = class_counts(df, label).where(F.col("n") >= min_count).select(label)
    return df.join(common, label, "left_semi").select(df.columns)


def dropped_classes(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Classes that a filter left without rows, and how many they had."""
    return class_counts(before, label).join(after.select(label).distinct(), label, "left_anti")


def whitelist(df: DataFrame, wanted: Sequence[str], label: str = "label") -> DataFrame:
    """Rows of the wanted classes."""
    return df.where(F.col(label).isin(*wanted))


def lookup(df: DataFrame, names: Mapping[str, str], col: str, out: str, default: str = "") -> DataFrame:
    """Adds a display value of a column from a small map; others get the default."""
    found = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    return df.withColumn(out, F.coalesce(F.try_element_at(found, F.col(col)), F.lit(default)))


def draw(seed: int, *cols: Column | str) -> Column:
    """A hash that orders rows at random, the same for any partitioning and in other engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary"))


def stratified_sample(df: DataFrame, n_samples: int, seed: int = 42, label: str = "label", key: str = "smarts") -> DataFrame:
    """From each class its share of ``n_samples``, one row at least, by hash order.

    Only ranks below the class quota are needed, so Spark limits each task's rows of a
    class before the shuffle.
    """
    from pyspark.sql import Window as W

    counts = class_counts(df, label).select(label, "n")
    total = counts.agg(F.sum("n").alias("total"))
    quota = counts.crossJoin(F.broadcast(total)).select(label, F.least("n", F.greatest(F.lit(1), F.floor(F.lit(n_samples) * F.col("n") / F.col("total")))).alias("quota"))
    most = quota.agg(F.max("quota")).first()[0] or 0
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy(draw(seed, key), key))).where(F.col("_rank") <= int(most))
    return ranked.join(F.broadcast(quota), label).where("_rank <= quota").select(df.columns)


def load_labelled(raw: DataFrame, validated: DataFrame, depth: int = 1, n_samples: int | None = None, seed: int = 42) -> tuple[DataFrame, int]:
    """Labelled rows of frequent classes, sampled if asked for, and how many there were before."""
    rows = written(join_labels(validated, label_map(raw, depth)), "labelled")  # counted three times below
    rows = drop_rare(rows, min_class_count(rows.count() if n_samples else 0, n_samples))
    available = rows.count()
    if n_samples and n_samples < available:
        rows = stratified_sample(rows, n_samples, seed)
    return rows, available
