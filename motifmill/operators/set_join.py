"""Exact join of token sets by their Tanimoto similarity.

Equal sets form a class, which is joined once.  The tokens of a set are ordered by rising
frequency; two sets that reach the threshold share a token among the first few of this order (the
prefix), and their sizes lie close together.  An inverted index of prefix tokens, split by the size
of the set, yields the candidates, each at the first token that the two prefixes share and only
if the tokens left can still reach the threshold; whole sets confirm them.  A token that nearly all
rows have stands last in the order and never enters a prefix of more than the smallest sets.

Defined cases: sets that are null or empty are linked with nothing; repeated tokens count once;
rows with one key are rows of their own; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.scratch import written

PERCENT = 80


def _least(n: Column, percent: int) -> Column:
    """The least size that a partner of a set of ``n`` can have: percent of it, rounded up."""
    return F.floor((n * percent + 99) / 100).cast("int")


def classes(df: DataFrame, key: str, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Members (key, class) and classes (class, tokens, n, size): the class of equal sets is named by its least key."""
    rows = df.select(F.col(key).alias("_k"), F.array_sort(F.array_distinct(F.filter(F.col(tokens), lambda t: t.isNotNull()))).alias("_s"))
    rows = rows.withColumn("_h", F.sha2(F.array_join(F.transform("_s", lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)), ""), 256))
    rows = written(rows, "sets")
    named = rows.where(F.size("_s") > 0).groupBy("_h").agg(F.min("_k").alias("class"), F.any_value("_s").alias("tokens"), F.count(F.lit(1)).alias("size"))
    named = written(named.withColumn("n", F.size("tokens")), "classes")
    members = rows.join(named.select("_h", "class"), "_h", "left").select(F.col("_k").alias(key), "class")
    return members, named.select("class", "tokens", "n", "size")


def candidates(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of classes (a, b; the set of a is not the smaller) that share a prefix token and may reach the threshold."""
    each = sets.select("class", "n", F.explode("tokens").alias("token"))
    frequency = each.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ordered = each.join(frequency, "token").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("o"))
    prefix = F.slice(F.transform("o", lambda x: x["token"]), 1, F.col("n") - _least(F.col("n"), percent) + 1)
    index = written(ordered.select("class", "n", prefix.alias("prefix")), "prefixes")
    posting = index.select("class", "n", "prefix", F.posexplode("prefix").alias("at", "token"))
    b = posting.select(*[F.col(c).alias(f"b_{c}") for c in ("class", "prefix", "at")], F.col("n").alias("size"), "token")
    # Classes differ, so two of one size share one token less than they have at most.
    sizes = F.filter(F.sequence(_least(F.col("n"), percent), F.col("n")), lambda m: (m < F.col("n")) | ((m - 1) * (100 + percent) >= 2 * m * percent))
    a = posting.select(*[F.col(c).alias(f"a_{c}") for c in ("class", "n", "prefix", "at")], "token", F.explode(sizes).alias("size"))
    met = a.join(b, ["token", "size"]).where((F.col("a_n") > F.col("size")) | (F.col("a_class") < F.col("b_class")))
    first = F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == F.col("token")
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("size") - F.col("b_at"))  # shared tokens at most, this one included
    reach = left * (100 + percent) >= (F.col("a_n") + F.col("size")) * percent
    return met.where(first & reach).select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))


def similar_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of classes with 100 * shared >= percent * all: a, b (a < b), similarity, and both sizes."""
    own = lambda c: sets.select(F.col("class").alias(c), F.col("tokens").alias(f"{c}_t"), F.col("size").alias(f"{c}_size"))
    both = candidates(sets, percent).join(own("a"), "a").join(own("b"), "b")
    shared = F.size(F.array_intersect("a_t", "b_t"))
    both = both.withColumn("i", shared).withColumn("u", F.size("a_t") + F.size("b_t") - F.col("i")).where(F.col("i") * 100 >= F.col("u") * percent)
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return both.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), (F.col("i") / F.col("u")).alias("similarity"), pick("a_size", "b_size").alias("a_size"), pick("b_size", "a_size").alias("b_size"))


def set_join(df: DataFrame, key: str, tokens: str = "tokens", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """A row for each row (key, class, n_links: the other rows that reach the threshold) and the pairs of classes."""
    members, sets = classes(df, key, tokens)
    pairs = written(similar_classes(sets, percent), "similar")
    links = pairs.select(F.col("a").alias("class"), F.col("b_size").alias("m")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a_size").alias("m")))
    links = links.groupBy("class").agg(F.sum("m").alias("m"))
    totals = sets.join(links, "class", "left").select("class", (F.col("size") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    out = members.join(totals, "class", "left").select(key, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out, pairs
