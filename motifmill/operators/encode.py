"""Token sequences as ids: lookup, special ids, truncation, padding."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.functions import tokenizer

PAD, UNK, BOS, EOS = 0, 1, 2, 3
#: A vocabulary up to this size goes into the plan as a map; a larger one is joined.
MAP_LIMIT = 20_000


def vocabulary_map(vocab: Mapping[str, int]) -> Column:
    if len(vocab) > MAP_LIMIT:
        raise ValueError(f"{len(vocab)} tokens: join the vocabulary with lookup_join")
    return F.from_json(F.lit(_json(vocab)), "map<string,bigint>")


def _json(vocab: Mapping[str, int]) -> str:
    import json

    return json.dumps(dict(vocab), ensure_ascii=False)


def lookup(tokens: Column, vocab: Mapping[str, int]) -> Column:
    """Ids of an array of tokens; unknown ones get the unknown id."""
    ids = vocabulary_map(vocab)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(UNK).cast("bigint")))


def lookup_join(df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """The same by a join of exploded tokens, for vocabularies of any size."""
    each = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    ids = each.join(vocab.select("token", F.col("id").cast("bigint").alias("id")), "token", "left")
    found = ids.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id"))))).alias("x"))
    return df.join(found.select(key, F.col("x.id").alias(out)), key, "left")


def frame(ids: Column, bos: bool = False, eos: bool = False) -> Column:
    """Ids with the begin and end ids around them."""
    parts = [F.array(F.lit(BOS).cast("bigint"))] * bos + [ids] + [F.array(F.lit(EOS).cast("bigint"))] * eos
    return F.concat(*parts) if len(parts) > 1 else ids


def pad(ids: Column, length: int) -> tuple[Column, Column]:
    """Ids cut at ``length`` (the end id may go) and padded on the right, and the mask of real positions."""
    if length < 1:
        raise ValueError("length is at least 1")
    cut = F.slice(ids, 1, length)
    n = F.size(cut)
    fill = F.array_repeat(F.lit(PAD).cast("bigint"), length - n)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return F.concat(cut, fill), F.concat(F.array_repeat(one, n), F.array_repeat(zero, length - n))


def dataset(df: DataFrame, vocab: Mapping[str, int], col: str = "smarts", max_length: int | None = None, bos: bool = False, eos: bool = False, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``input_ids``, ``attention_mask`` and ``ok``; a row that fails is all padding.

    Without ``max_length`` the longest row counts (one pass).  ``tokenize`` replaces the
    grammar tokenizer by any function of a column to an array of strings.
    """
    if tokenize is None:
        parts = tokenizer.with_tokens(df, col, "_tokens", "ok")
    else:
        parts = df.withColumn("_tokens", tokenize(F.col(col))).withColumn("ok", F.col("_tokens").isNotNull())
    empty = F.array().cast("array<bigint>")
    ids = parts.withColumn("_ids", F.when(F.col("ok"), frame(lookup(F.col("_tokens"), vocab), bos, eos)).otherwise(empty))
    if max_length is None:
        max_length = max(1, ids.agg(F.max(F.size("_ids"))).first()[0] or 1)
    padded, mask = pad(F.col("_ids"), max_length)
    return ids.select(*df.columns, padded.alias("input_ids"), mask.alias("attention_mask"), "ok")


def dataset_from_files(spark: SparkSession, vocabulary: str, lines: str, max_length: int | None = None, bos: bool = False, eos: bool = False) -> DataFrame:
    """The dataset of a file of strings and a vocabulary JSON, both in any store that Spark reads; rows keep their order ``ord``."""
    import json

    from motifmill.sources import files

    text = "\n".join(r["value"] for r in spark.read.text(vocabulary, wholetext=True).collect())  # one file of thousands of tokens
    return dataset(files.read_lines(spark, lines), json.loads(text)["token_to_id"], "smarts", max_length, bos, eos)


def sequence_lengths(ids: str = "_ids") -> list[Column]:
    """Longest (1 if there is none) and mean sequence."""
    return [F.coalesce(F.max(F.size(ids)), F.lit(1)).alias("max_length"), F.avg(F.size(ids)).alias("mean_length")]
