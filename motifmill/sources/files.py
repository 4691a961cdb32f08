"""Sources with an explicit row order, and sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill import schemas
from motifmill.functions.text import is_true, strip

# The words that pandas reads as missing by default.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def order(file_rank: int) -> Column:
    """A row's place: its file, the block of the file, and its place in the block."""
    return F.struct(F.lit(file_rank).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Text columns of CSV files in the given order, with ``ord``; missing words are null.

    Columns are found by name in each header, so files may hold others too.  With ``multi_line``
    quoted fields may hold line feeds; such a file is then read by one task.
    """
    parts = []
    for rank, path in enumerate(paths):
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        names = raw.csv(path).columns
        absent = [c for c in schema.names if c not in names]
        if absent:
            raise ValueError(f"{path} has no {', '.join(absent)}")
        full = T.StructType([T.StructField(c, T.StringType()) for c in names])
        df = raw.schema(full).csv(path)
        cols = [F.when(~F.col(f"`{c}`").isin(*NA_WORDS), F.col(f"`{c}`")).alias(c) for c in schema.names]
        parts.append(df.select(order(rank).alias("ord"), *cols))
    if not parts:
        raise ValueError("no paths were given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_raw(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    return read_csv(spark, paths, schemas.RAW, multi_line)


def read_raw_labels(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    return read_csv(spark, paths, schemas.RAW_LABELS, multi_line)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines without outer white space, in order."""
    return spark.read.text(path).select(order(0).alias("ord"), strip(F.col("value")).alias("smarts")).where("smarts <> ''")


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """The valid rows of a validated table (CSV with a header, or Parquet)."""
    if path.endswith(".csv") or "_csv" in path:
        names = spark.read.option("header", True).csv(path).columns
        df = read_csv(spark, [path], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    else:
        df = spark.read.parquet(path).withColumn("ord", order(0))
    return df.where(is_true(F.col("valid"))).drop("valid")


def read_groups(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The group map, or none where there is no such file."""
    if path is None or not _exists(spark, path):
        return None
    return read_csv(spark, [path], schemas.GROUPS).drop("ord")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(candidates: Sequence[str | None], least_bytes: int = 1) -> str:
    """The first of the given files that is there and has at least so many bytes (none is downloaded)."""
    said = []
    for path in filter(None, candidates):
        size = os.path.getsize(path) if os.path.isfile(path) else None
        if size is not None and size >= least_bytes:
            return path
        said.append(f"{path}: {'missing' if size is None else f'{size} bytes'}")
    raise FileNotFoundError(f"no file of {least_bytes} bytes or more ({'; '.join(said) or 'none given'})")


def read_vocabulary(path: str) -> dict[str, int]:
    return json.loads(Path(path).read_text())["token_to_id"]


# --- sinks ------------------------------------------------------------------


def write_lines(df: DataFrame, path: str, col: str = "TEMPLATE") -> None:
    """One string per line, never quoted."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Fields as they are: outer white space is kept, which Spark's writer drops by default."""
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).csv(path)


def write_vocabulary(vocab: DataFrame, path: str) -> dict:
    """The vocabulary as JSON: maps both ways, frequencies in order, and the size.

    A vocabulary has thousands of rows; they are read in id order through one iterator.
    """
    rows = vocab.orderBy("id").toLocalIterator()
    token_to_id, frequencies = {}, {}
    for r in rows:
        token_to_id[r["token"]] = r["id"]
        if r["freq"] is not None:
            frequencies[r["token"]] = r["freq"]
    out = {"token_to_id": token_to_id, "id_to_token": {str(i): t for t, i in token_to_id.items()}, "frequencies": dict(sorted(frequencies.items(), key=lambda x: -x[1])), "size": len(token_to_id)}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2))
    return out


FORMATS = ("npy", "json", "csv")


def infer_format(output: str | None, fmt: str | None = None) -> str:
    """The format asked for, else that of the file's ending, else JSON."""
    if fmt:
        return fmt
    ending = os.path.splitext(output or "")[1][1:]
    return ending if ending in FORMATS else "json"


def write_predictions(df: DataFrame, path: str, fmt: str | None = None, dims: int | None = None) -> None:
    """Strings with their vectors: distributed JSON lines or CSV, or one npy matrix.

    The npy sink gathers the vectors on the driver in the order of ``ord`` if there is
    such a column; take it for results that fit there.
    """
    kind = infer_format(path, fmt)
    if kind == "json":
        df.select("smarts", "embedding").write.mode("overwrite").json(path)
    elif kind == "csv":
        dims = dims or len(df.select("embedding").first()["embedding"])
        cols = [F.get("embedding", F.lit(k)).alias(f"dim_{k}") for k in range(dims)]
        write_csv(df.select("smarts", *cols), path)
    elif kind == "npy":
        rows = df.orderBy("ord") if "ord" in df.columns else df
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        np.save(path, np.array([r["embedding"] for r in rows.select("embedding").toLocalIterator()], np.float32))
    else:
        raise ValueError(f"Unknown format {kind!r}")


def blank_free(values: Sequence[str]) -> list[str]:
    return [v.strip() for v in values if v.strip()]



# --- embedding index ----------------------------------------------------------


def write_index(df: DataFrame, path: str, pooling: str) -> None:
    """Strings with their vectors and the pooling that made them."""
    df.select("smarts", "embedding", F.lit(pooling).alias("pooling")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, pooling: str | None = None) -> DataFrame:
    """The index; an error if it was made with another pooling than the queries will be."""
    df = spark.read.parquet(path)
    if pooling is not None and (other := df.where(F.col("pooling") != pooling).select("pooling").first()):
        raise ValueError(f"the index was made with {other['pooling']} pooling, not {pooling}")
    return df.select("smarts", "embedding")
