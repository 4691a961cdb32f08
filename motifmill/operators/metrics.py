"""Metrics of classifiers and masked-token models, and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts of label and prediction, and each count's share of its label."""
    n = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("label")))


def class_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class seen as label or prediction."""
    n = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = n.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q")), F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q")))).alias("x"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    out = each.groupBy(F.col("x.c").alias("label")).agg((F.sum("hit") / 2).alias("hit"), F.sum("x.s").alias("support"), F.sum("x.q").alias("chosen"))
    precision, recall = F.coalesce(F.col("hit") / F.nullif(F.col("chosen"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("hit") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    out = out.select("label", precision.alias("precision"), recall.alias("recall"), "support")
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def summary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy, macro F1 and weighted F1."""
    per = class_metrics(df, label, predicted)
    f1 = per.agg(F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))
    return f1


def masked_accuracy(df: DataFrame, content_ids: frozenset[int] | set[int]) -> DataFrame:
    """Hits among the first and first five guesses at masked positions, all and content ones.

    Rows hold ``labels`` (-100 outside masks) and ``guesses`` (five best ids a position).
    """
    each = df.select(F.explode(F.arrays_zip("labels", "guesses")).alias("x")).where("x.labels <> -100")
    content = F.col("x.labels").isin(*sorted(content_ids)) if content_ids else F.lit(False)
    first, five = F.get("x.guesses", F.lit(0)) == F.col("x.labels"), F.array_contains(F.slice("x.guesses", 1, 5), F.col("x.labels"))
    share = lambda hit, of: F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    yes = F.lit(True)
    return each.agg(share(first, yes).alias("top1"), share(five, yes).alias("top5"), share(first, content).alias("content_top1"), share(five, content).alias("content_top5"))


def best_epoch(history: DataFrame, loss: str = "val_loss") -> DataFrame:
    """The first epoch with the least loss."""
    return history.agg(F.min(F.struct(loss, "epoch")).alias("x")).select("x.epoch", F.col(f"x.{loss}"))


def schedule(spark: SparkSession, total: int, warmup: int) -> DataFrame:
    """The rate's factor at each step: it rises in a line for ``warmup`` steps, then falls to 0 along half a cosine."""
    step = F.col("step")
    cosine = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / max(total - warmup, 1))))
    return spark.range(total).select(F.col("id").alias("step")).select("step", F.when(step < warmup, step / max(warmup, 1)).otherwise(cosine).alias("factor"))
