"""Vocabulary of a token corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPECIALS = ("[PAD]", "[UNK]", "[BOS]", "[EOS]")


def token_frequencies(df: DataFrame, tokens: str = "tokens", order: str = "ord") -> DataFrame:
    """Each token's count and its first place; rows without tokens add nothing."""
    each = df.select(order, F.posexplode(tokens).alias("pos", "token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct(order, "pos")).alias("first"))


def build(df: DataFrame, specials: Sequence[str] = SPECIALS, tokens: str = "tokens", order: str = "ord") -> DataFrame:
    """Token, id and frequency: specials first, then by count, ties by first appearance.

    A corpus token named like a special keeps the special's id and its frequency.
    """
    counted = token_frequencies(df, tokens, order)
    special = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(specials)], "token string, special int")
    # One pass over the corpus: the specials are rows of the counted table.
    both = counted.withColumn("special", F.lit(None).cast("int")).unionByName(special, allowMissingColumns=True)
    each = both.groupBy("token").agg(F.max("special").alias("special"), F.max("freq").alias("freq"), F.min("first").alias("first"))
    learned = F.col("special").isNull()
    rank = F.row_number().over(W.partitionBy(learned).orderBy(F.col("freq").desc(), "first"))  # one row a token
    return each.select("token", F.coalesce("special", rank + len(specials) - 1).cast("int").alias("id"), "freq")
