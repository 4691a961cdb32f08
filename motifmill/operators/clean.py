"""Cleaning, keep-first dedup, reaction groups and validation of template tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.functions import structure, tokenizer
from motifmill.functions.text import is_true, not_blank, strip


def keep_first(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key.

    One partially aggregated shuffle: each task sends one row a key, so a key that holds
    a third of all rows costs no more than another.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.min_by(F.struct(*rest), F.col(order)).alias("x") if rest else F.lit(None).alias("x")
    out = df.groupBy(key).agg(F.min(order).alias(order), row)
    return out.select(*[F.col(f"x.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def filtered(raw: DataFrame) -> DataFrame:
    """Valid rows with a template, stripped, the first of each template.

    The filter comes before the dedup: an invalid first row hides no later valid one.
    """
    rows = raw.where(is_true(F.col("VALID")) & not_blank(F.col("TEMPLATE")))
    return keep_first(rows.withColumn("TEMPLATE", strip(F.col("TEMPLATE"))), "TEMPLATE")


def clean(raw: DataFrame) -> DataFrame:
    return filtered(raw).select("ord", "TEMPLATE")


def reaction_groups(raw: DataFrame) -> DataFrame:
    """Each template's group: its reactions as given, or itself if they are blank."""
    group = F.when(not_blank(F.col("REACTIONS")), F.col("REACTIONS")).otherwise(F.col("TEMPLATE"))
    return filtered(raw).select(F.col("TEMPLATE").alias("smarts"), group.alias("reaction_group"))


def validate(df: DataFrame, col: str = "smarts") -> DataFrame:
    """Adds validity and structure counts; order and repeated rows stay."""
    parts = tokenizer.with_tokens(df, col, "_tokens", "_ok")
    return parts.withColumn("_x", structure.structure(F.col("_tokens"), F.col("_ok"))).select(*df.columns, "_x.*")


def attach_groups(df: DataFrame, groups: DataFrame | None, key: str = "smarts") -> DataFrame:
    """Left join of the group map; a row without a group is its own."""
    if groups is None:
        return df.withColumn("reaction_group", F.col(key))
    return df.join(groups, key, "left").withColumn("reaction_group", F.coalesce("reaction_group", key))
