"""Row-wise operators on streams: they are stateless, so batch and stream share them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill import schemas
from motifmill.functions import tokenizer
from motifmill.functions.text import is_true, not_blank, strip
from motifmill.operators import encode


def template_stream(spark, folder: str) -> DataFrame:
    """Raw template rows of CSV files as they arrive in a folder."""
    return spark.readStream.schema(schemas.RAW).option("header", True).option("escape", '"').csv(folder)


def clean_stream(raw: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Valid templates; with an event time, one of each template within the watermark."""
    rows = raw.where(is_true(F.col("VALID")) & not_blank(F.col("TEMPLATE"))).withColumn("smarts", strip(F.col("TEMPLATE")))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["smarts"]) if time else rows


def encode_stream(rows: DataFrame, vocab: Mapping[str, int], max_length: int, bos: bool = False, eos: bool = False) -> DataFrame:
    return encode.dataset(rows, vocab, max_length=max_length, bos=bos, eos=eos)


def token_rate(events: DataFrame, time: str, col: str, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows and tokens in each tumbling window, closed by the watermark."""
    parts = tokenizer.tokens(F.col(col))
    rows = events.withColumn("_n", F.when(tokenizer.covers(F.col(col), parts), F.size(parts)))
    return rows.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("tokens"), F.count_if(F.col("_n").isNull()).alias("failed"))
