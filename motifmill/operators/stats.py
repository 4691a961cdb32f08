"""Distributions of lengths, vectors and similarities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions.vectors import norm


def length_distribution(df: DataFrame, length: Column, thresholds: Sequence[int] = (256, 512), exact: bool = True) -> DataFrame:
    """Count, extremes, mean, percentiles, and share at thresholds; ``exact=False`` for sketches at scale."""
    rows = df.select(length.alias("n"))
    q = (lambda p: F.percentile("n", F.lit(p))) if exact else (lambda p: F.percentile_approx("n", p, 10_000).cast("double"))
    cols = [
        F.count("n").alias("n"),
        F.min("n").cast("bigint").alias("min"),
        q(0.5).alias("median"),
        F.avg("n").alias("mean"),
        *[q(p / 100).alias(f"p{p}") for p in (75, 90, 95, 99)],
        F.max("n").cast("bigint").alias("max"),
    ]
    for t in thresholds:
        cols += [F.count_if(F.col("n") <= t).alias(f"n_le_{t}"), (100 * F.avg((F.col("n") <= t).cast("double"))).alias(f"pct_le_{t}")]
    return rows.agg(*cols)


def tokenizer_report(df: DataFrame, text: str, tokens: str, ok: str = "ok") -> DataFrame:
    """Error rate, length statistics, fertility, distinct tokens and round trips of a tokenizer."""
    n = F.when(F.col(ok), F.size(tokens))
    used = F.explode(F.col(tokens))
    distinct = df.where(ok).select(used.alias("t")).agg(F.count_distinct("t").alias("unique_tokens"))
    chars = F.length(text)
    main = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((~F.col(ok)).cast("double")).alias("error_rate"),
        F.avg(n).alias("mean_tokens"),
        F.percentile(n, F.lit(0.5)).alias("median_tokens"),
        F.stddev_pop(n).alias("std_tokens"),
        F.min(n).cast("bigint").alias("min_tokens"),
        F.max(n).cast("bigint").alias("max_tokens"),
        F.avg(n / F.nullif(chars, F.lit(0))).alias("fertility"),
        (F.avg(n) / F.avg(F.when(F.col(ok), chars))).alias("fertility_of_means"),
        F.avg(F.when(F.col(ok), (F.array_join(tokens, "") == F.col(text)).cast("double"))).alias("round_trip"),
    )
    return main.crossJoin(F.broadcast(distinct))  # one row each


def compare_tokenizers(reports: Mapping[str, tuple[DataFrame, int]], text: str, tokens: str, ok: str = "ok") -> DataFrame:
    """A report of each tokenizer's rows, and the share of its vocabulary (of the given size) that they use."""
    parts = []
    for name, (rows, size) in reports.items():
        use = F.col("unique_tokens") / F.lit(max(1, size))
        parts.append(tokenizer_report(rows, text, tokens, ok).select(F.lit(name).alias("tokenizer"), "*", use.alias("vocabulary_use")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dimension_variance(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Population variance of each dimension."""
    each = df.select(F.posexplode(col).alias("dim", "x"))
    return each.groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def norm_summary(df: DataFrame, col: str = "embedding") -> DataFrame:
    n = df.select(norm(F.col(col)).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))


def bucket(col: Column, low: float, high: float, bins: int) -> Column:
    """The equal-width bin of a value from 0; the upper edge is in the last bin."""
    place = F.floor((col - F.lit(low)) / F.lit((high - low) / bins))
    return F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("bigint")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(bucket(F.col(col), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], bins: int = 50) -> DataFrame:
    x0, x1, y0, y1 = bounds
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return cells.groupBy(bucket(F.col(x), x0, x1, bins).alias("x_bin"), bucket(F.col(y), y0, y1, bins).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def hexagons(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], across: int = 40, up: int = 24) -> DataFrame:
    """(lattice, column, row, n) of hexagonal bins: each point goes to the nearest centre of two rectangular lattices.

    The second lattice lies half a step from the first; vertical distances count three times
    squared, which makes the bins regular hexagons of a plane so scaled.  Points with a null are left out.
    """
    x0, x1, y0, y1 = bounds
    rows = df.select(((F.col(x) - x0) / ((x1 - x0) / across)).alias("u"), ((F.col(y) - y0) / ((y1 - y0) / up)).alias("v")).where("u is not null and v is not null")
    rows = rows.withColumns({"a": F.floor(F.col("u") + 0.5), "b": F.floor(F.col("v") + 0.5), "c": F.floor("u"), "d": F.floor("v")})
    far = lambda a, b: (F.col("u") - a) * (F.col("u") - a) + 3 * (F.col("v") - b) * (F.col("v") - b)
    first = far(F.col("a"), F.col("b")) < far(F.col("c") + 0.5, F.col("d") + 0.5)
    cells = rows.select(F.when(first, 0).otherwise(1).alias("lattice"), F.when(first, F.col("a")).otherwise(F.col("c")).alias("column"), F.when(first, F.col("b")).otherwise(F.col("d")).alias("row"))
    return cells.groupBy("lattice", "column", "row").agg(F.count(F.lit(1)).alias("n"))


#: Size of a length sketch: with 1000 a quantile's rank is off by about 0.4 % of the rows at most (99 %).
SKETCH = 1000


def length_sketches(df: DataFrame, length: Column, part: str, k: int = SKETCH) -> DataFrame:
    """(part, n, sketch): a mergeable sketch of the lengths of each part, to be stored; null lengths do not count.

    Parts that are added later are sketched alone and their rows appended.
    """
    rows = df.select(F.col(part).alias("part"), length.cast("bigint").alias("n")).where(F.col("n").isNotNull())
    return rows.groupBy("part").agg(F.count("n").alias("n"), F.kll_sketch_agg_bigint("n", F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, ranks: Sequence[float], k: int = SKETCH) -> DataFrame:
    """(rank, value) of all stored parts together: one small row of each part is merged, no length is read again."""
    merged = sketches.agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("s"))
    each = F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_bigint("s", F.lit(float(r))).alias("value")) for r in ranks])
    return merged.where(F.kll_sketch_get_n_bigint("s") > 0).select(F.inline(each))
