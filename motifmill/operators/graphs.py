"""Graphs and path fingerprints of the templates of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.functions import graph, tokenizer
from motifmill.functions.fold import let
from motifmill.operators import clean


def _sides(df: DataFrame, col: str) -> DataFrame:
    """Valid rows with the graphs of their sides (``_sides``, reactants first), made once a row."""
    rows = clean.validate(df, col).where("valid").select(*df.columns, F.array("reactant_smarts", "product_smarts").alias("_texts"))
    for k, name in enumerate(("_left", "_right")):
        rows = rows.withColumn("_text", F.get("_texts", F.lit(k)))
        rows = tokenizer.with_tokens(rows, "_text", f"{name}_t", f"{name}_ok")
    graphs = F.transform(F.array("_left_t", "_right_t"), graph.graph)
    return rows.select(*df.columns, F.when(F.spark_partition_id() >= 0, graphs).alias("_sides"))


def template_graph(df: DataFrame, col: str = "smarts") -> DataFrame:
    """Valid rows with ``sides`` (atoms and bonds of reactants and products), ``degrees``, ``n_bonds`` and ``n_rings``."""
    total = lambda size: F.aggregate(F.transform("_sides", size), F.lit(0), lambda s, x: s + x)
    return _sides(df, col).select(
        *df.columns,
        F.col("_sides").alias("sides"),
        F.transform("_sides", graph.degrees).alias("degrees"),
        total(lambda g: F.size(g["bonds"])).alias("n_bonds"),
        total(lambda g: F.size(F.filter(g["bonds"], lambda b: b["ring"]))).alias("n_rings"),
    )


def path_fingerprint(df: DataFrame, col: str = "smarts", longest: int = graph.PATH, bits: int = graph.BITS) -> DataFrame:
    """Valid rows with ``fingerprint``: the paths of both sides, told apart, folded into ``bits`` bits as longs."""
    named = F.transform("_sides", lambda g, side: F.transform(graph.path_names(g, longest), lambda n: graph.bit_of(F.concat(side.cast("string"), F.lit(":"), n), bits)))
    words = let(F.array_distinct(F.flatten(named)), lambda places: graph.fold_bits(places, bits))
    return _sides(df, col).select(*df.columns, F.when(F.spark_partition_id() >= 0, words).alias("fingerprint"))
