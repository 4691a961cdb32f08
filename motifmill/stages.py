"""The corpus stages from the command line: ``python -m motifmill.stages clean|validate|vocab|labels``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from motifmill.functions import tokenizer
from motifmill.operators import clean, labels, vocab
from motifmill.session import session
from motifmill.sources import files


def clean_stage(spark: SparkSession, raw: list[str], output: str, groups: str | None = None) -> None:
    """Raw tables to the clean list and the group map."""
    rows = files.read_raw(spark, raw)
    files.write_lines(clean.clean(rows), output)
    if groups:
        files.write_csv(clean.reaction_groups(rows), groups)


def validate_stage(spark: SparkSession, lines: str, output: str, groups: str | None = None) -> DataFrame:
    """The clean list to the validated table with groups, as Parquet; the tally of valid rows, counted as they are written."""
    rows = clean.validate(files.read_lines(spark, lines).drop("ord"))
    return tally_of(clean.attach_groups(rows, files.read_groups(spark, groups)), output)


def tally_of(rows: DataFrame, output: str) -> DataFrame:
    """Writes rows as Parquet; (valid, n) from metrics of that one write, without rows of no count."""
    seen = Observation("validated")
    counts = [F.count_if(F.col("valid") == v).alias(str(v)) for v in (True, False)]
    rows.observe(seen, *counts, F.count_if(F.col("valid").isNull()).alias("None")).write.mode("overwrite").parquet(output)
    found = [(v, seen.get[str(v)]) for v in (True, False, None) if seen.get[str(v)]]
    return rows.sparkSession.createDataFrame(found, "valid boolean, n bigint")


def vocab_stage(spark: SparkSession, validated: str, output: str) -> dict:
    """The valid rows to a vocabulary JSON."""
    rows = tokenizer.with_tokens(files.read_validated(spark, validated).select("ord", "smarts"), "smarts")
    return files.write_vocabulary(vocab.build(rows), output)


def labels_stage(spark: SparkSession, raw: list[str], validated: str, output: str, depth: int = 1, n_samples: int | None = None, seed: int = 42) -> int:
    """Labelled rows as Parquet; how many there were before sampling."""
    rows, available = labels.load_labelled(files.read_raw_labels(spark, raw), files.read_validated(spark, validated), depth, n_samples, seed)
    rows.write.mode("overwrite").parquet(output)
    return available


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="motifmill-stages", description=__doc__)
    sub = p.add_subparsers(dest="stage", required=True)
    for name in ("clean", "validate", "vocab", "labels"):
        s = sub.add_parser(name)
        s.add_argument("--output", "-o", required=True)
        if name in ("clean", "labels"):
            s.add_argument("--raw", nargs="+", required=True)
        if name in ("clean", "validate"):
            s.add_argument("--groups")
        if name == "validate":
            s.add_argument("--lines", required=True)
        if name in ("vocab", "labels"):
            s.add_argument("--validated", required=True)
        if name == "labels":
            s.add_argument("--depth", type=int, default=1)
            s.add_argument("--samples", type=int)
            s.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    spark = session()
    if a.stage == "clean":
        clean_stage(spark, a.raw, a.output, a.groups)
    elif a.stage == "validate":
        for r in validate_stage(spark, a.lines, a.output, a.groups).collect():
            print(f"valid={r['valid']}: {r['n']}")
    elif a.stage == "vocab":
        print(vocab_stage(spark, a.validated, a.output)["size"])
    else:
        print(labels_stage(spark, a.raw, a.validated, a.output, a.depth, a.samples, a.seed))
    return 0


if __name__ == "__main__":
    sys.exit(main())
