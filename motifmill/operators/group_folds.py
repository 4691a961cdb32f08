"""Folds that keep groups whole and come near the label shares of all rows.

Groups are taken with the counts of all their labels, not only of the most frequent one, large
groups first, and each goes to the fold whose label counts it brings nearest to their share.
Two rounds: the ``HEAD`` largest groups one after the other in one task, then the
others in tasks of ``PER_TASK`` groups, each of which starts with its part of the totals so far
and so evens out what the first round left.  Only totals by fold and label
(``folds`` x labels, bounded by ``MAX_LABELS``) come to the driver.

Within a task every label's counts in two folds differ by no more than about the largest group
it deals; tasks deviate independently, so the shares of T tasks deviate with the square root of T.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifmill.operators.labels import draw
from motifmill.scratch import written

HEAD, PER_TASK, MAX_LABELS = 2000, 20_000, 10_000


def deal(counts: np.ndarray, totals: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Folds of groups (rows of label counts) one after the other; ``start`` has the counts of the folds so far.

    The cost of a fold is the sum of squared shares that its labels exceed or lack; ties go to the
    fold with fewer rows, then to the first.
    """
    state, out = start.astype(np.float64).copy(), np.zeros(len(counts), np.int32)
    weight = 1 / np.maximum(totals, 1.0) ** 2
    for k, c in enumerate(counts):
        # (state + c)^2 - state^2 summed over labels: what the group adds to the squares.
        added = ((2 * state + c) * c * weight).sum(axis=1)
        fold = np.lexsort((np.arange(len(state)), state.sum(axis=1), np.round(added, 12)))[0]
        state[fold] += c
        out[k] = fold
    return out


def stratified_group_folds(df: DataFrame, folds: int = 5, seed: int = 42, group: str = "group", label: str = "label") -> DataFrame:
    """Adds ``fold``, the same for all rows of a group; rows without a label count as a label of their own."""
    if folds < 2:
        raise ValueError("at least two folds")
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    each = written(df.groupBy(key.alias("g"), name.alias("l")).agg(F.count(F.lit(1)).alias("n")), "label_counts")
    total = {r["l"]: r["n"] for r in each.groupBy("l").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(total) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    place = {l: k for k, l in enumerate(sorted(total))}
    totals = np.array([total[l] for l in sorted(total)], np.float64)
    groups = each.groupBy("g").agg(F.sum("n").alias("size"), F.collect_list(F.struct("l", "n")).alias("counts"))
    groups = written(groups.withColumn("h", draw(seed, F.col("g"))), "groups")
    order = [F.desc("size"), "h", "g"]
    head = written(groups.orderBy(*order).limit(HEAD), "head")
    rest = groups.join(head.select("g"), "g", "left_anti")
    tasks = max(1, -(-rest.count() // PER_TASK))

    def dealt(rows: DataFrame, part, start: np.ndarray, n_tasks: int) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "h", "g"], ascending=[False, True, True], kind="stable")
            counts = np.zeros((len(pdf), len(totals)))
            for k, own in enumerate(pdf["counts"]):
                for x in own:
                    counts[k, place[x["l"]]] = x["n"]
            return pd.DataFrame({"g": pdf["g"], "fold": deal(counts, totals, start / n_tasks)})

        return rows.withColumn("part", part).groupBy("part").applyInPandas(one, "g string, fold int")

    first = written(dealt(head, F.lit(0), np.zeros((folds, len(totals))), 1), "first")
    state = np.zeros((folds, len(totals)))
    for r in each.join(first, "g").groupBy("fold", "l").agg(F.sum("n").alias("n")).collect():
        state[r["fold"], place[r["l"]]] = r["n"]
    second = dealt(rest, F.pmod(F.xxhash64("g"), F.lit(tasks)), state, tasks)
    found = written(first.unionByName(second), "folds")
    return df.withColumn("_g", key).join(found.withColumnRenamed("g", "_g"), "_g").select(*df.columns, "fold")


def stratified_folds(df: DataFrame, folds: int = 5, seed: int = 42, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Adds ``fold``: rows of each label in hash order, dealt in turn, so that counts differ by one at most.

    The turn goes on from label to label, so that folds also differ by one row at most.
    """
    h = draw(seed, F.col(key))
    rows = df.withColumn("_h", h).withColumn("_l", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")))
    ranged = rows.repartitionByRange("_l", "_h", key).sortWithinPartitions("_l", "_h", key).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_p", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a task
    shift = sizes.select("_p", (before - F.col("first")).alias("shift"))
    return ranged.join(shift, "_p").select(*df.columns, ((F.col("_at") + F.col("shift")) % folds).cast("int").alias("fold"))
