"""The place of every row within its group, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifmill.llm import common


def numbered(df: DataFrame, group: str, order: list[str], scratch: common.Scratch, name: str) -> DataFrame:
    """Adds i (from 0, by ``order`` within ``group``) and n (rows of the group); ``group`` holds no nulls.

    One range shuffle by group and order: a group with a third of all rows lies in many tasks.
    A row's place is its place in its task, plus the rows of its group in the tasks before;
    those counts are one row for each group and task.  Rows that agree in ``order`` keep the
    order in which they are written.
    """
    keys = [group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.write(placed, name).withColumn("_task", F.shiftright("_at", 33))
    runs = placed.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    every = W.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(every.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("n"))
    return placed.join(runs, [group, "_task"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("i"), "n")
