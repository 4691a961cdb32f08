"""A corpus pipeline of the training-data operators: each stage works on all that the one before kept.

Documents that the quality classifier rejects go; one document of each group of near
copies stays; passages that repeat are cut out of the texts; documents that hold a
benchmark passage go; what is left is packed into sequences.  ``run`` writes every
stage as Parquet in the shared scratch folder, rereads it for the next one and drops the one
before, and what a stage stored on its way.

Defined cases: documents with null or empty texts are scored like texts without words; rows
without an id and repeated rows are documents of their own until near-dedup keeps one of them;
an empty table gives an empty plan; very long texts pass all stages whole; columns beside those
of documents are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifmill.llm import common, decontaminate, near_dedup, packing, quality, substring_dedup
from motifmill.scratch import removed_after

STAGES = [
    ("quality", quality.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES:
        with removed_after(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if done:
            scratch.drop(done)
        done = name
    return docs
