"""An inverted-file index of vectors: lists around centres, of which a search reads the nearest.

The coarse quantiser is k-means on unit vectors, fitted on a bounded sample (``SAMPLE`` rows in
hash order); every row is indexed.  Lists are folders of a Parquet table in the shared scratch
folder, each in files of bounded rows, so a list that holds a third of all rows is many files.
A search sends each query to its ``probes`` nearest lists, reads the folders of those only, and
multiplies blocks of queries and rows of one list; ``probes=None`` reads all lists and is exact.

Defined cases: null vectors are left out; a zero vector has similarity 0 with all; ties go to the
smaller key; an empty table gives an empty index and no results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.functions.vectors import EPSILON, normalise
from motifmill.operators.labels import draw
from motifmill.scratch import shared_folder, written

#: Rows that the centres are fitted on at most, and rows of a file.
SAMPLE, FILE_ROWS = 20_000, 50_000
#: Bytes of centres that are sent to the tasks at most.
CENTRE_BYTES = 64 << 20
#: Queries and rows that meet in one product.
BLOCK = 1024


def _unit(rows: list, dims: int) -> np.ndarray:
    m = np.array(rows, np.float64) if rows else np.zeros((0, dims))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPSILON)


@dataclass
class VectorIndex:
    """Where the lists are, and their centres."""

    path: str
    centres: np.ndarray
    key: str = "vec_id"
    col: str = "embedding"

    @classmethod
    def build(cls, df: DataFrame, lists: int, key: str = "vec_id", col: str = "embedding", seed: int = 42, sample: int = SAMPLE) -> VectorIndex:
        rows = df.where(F.col(col).isNotNull()).select(key, col)
        some = written(rows.orderBy(draw(seed, F.col(key)), key).limit(sample).select(array_to_vector(normalise(F.col(col))).alias("features")), "sample")
        there = some.count()
        if there:
            model = KMeans(k=min(lists, there), seed=seed, maxIter=15, initMode="k-means||").fit(some)
            centres = np.array(model.clusterCenters())
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), EPSILON)
        else:
            centres = np.zeros((1, 0))  # one list, without rows
        if centres.nbytes > CENTRE_BYTES:
            raise ValueError(f"{centres.nbytes} bytes of centres: take fewer lists")
        index = cls(shared_folder(df.sparkSession, "vectors"), centres, key, col)
        placed = index._nearest(rows, 1).select(key, col, F.get("lists", F.lit(0)).alias("list"))
        placed = written(placed, "placed")
        # Rows of a list are dealt to as many tasks as it needs files; no task gets a whole hot list, a short list is one file.
        sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("files"))  # one row a centre
        salted = placed.join(F.broadcast(sizes), "list").withColumn("salt", F.pmod(F.xxhash64(key), F.col("files")))
        salted.repartition("list", "salt").select(key, col, "list").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(index.path)
        return index

    def _nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """Adds ``lists``: the ``probes`` nearest centres, nearest first."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centres)
        schema = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    m = _unit(part.column(part.schema.get_field_index(self.col)).to_pylist(), c.shape[1])
                    scores = m @ c.T if c.shape[1] else np.zeros((len(m), 1))
                    near = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "lists"])

        return rows.mapInArrow(run, schema)

    def table(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        schema = T.StructType([df.schema[self.key], df.schema[self.col], T.StructField("list", T.IntegerType())])
        return spark.read.schema(schema).parquet(self.path)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = True) -> DataFrame:
        """(query, neighbour, similarity, rank) of the best ``k`` rows in the lists probed, for every query."""
        lists = len(self.centres)
        probes = min(lists, probes or lists)
        wanted = self._nearest(queries.where(F.col(self.col).isNotNull()).select(self.key, self.col), probes)
        wanted = written(wanted.select(F.col(self.key).alias("q"), F.col(self.col).alias("v"), F.explode("lists").alias("list")), "probes")
        rows = self.table(queries)
        if probes < lists:
            read = [r["list"] for r in wanted.select("list").distinct().collect()]  # at most as many as centres
            rows = rows.where(F.col("list").isin(read))
        # Blocks of queries and of rows of one list meet in a grid, so that no task holds a whole list.
        sides = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("nq")), rows.groupBy("list").agg(F.count(F.lit(1)).alias("nr"))
        sizes = sides[0].join(sides[1], "list").select("list", F.ceil(F.col("nq") / BLOCK).alias("bq"), F.ceil(F.col("nr") / (4 * BLOCK)).alias("br"))
        block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("bigint")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        q = wanted.join(sizes, "list").select("list", block("q", "bq").alias("x"), every("br").alias("y"), "q", "v")
        r = rows.join(sizes, "list").select("list", every("bq").alias("x"), block(self.key, "br").alias("y"), F.col(self.key).alias("r"), F.col(self.col).alias("w"))
        kind = queries.schema[self.key].dataType.simpleString()
        dims = self.centres.shape[1]

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            a, b = _unit(left["v"].tolist(), dims), _unit(right["w"].tolist(), dims)
            qs, rs = left["q"].to_numpy(), right["r"].to_numpy()
            s = a @ b.T if len(a) and len(b) else np.zeros((len(a), len(b)))
            if exclude_self:
                s[qs[:, None] == rs[None, :]] = -np.inf
            bar = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1] if s.size else np.zeros(len(a))
            i, j = np.nonzero((s >= bar[:, None]) & np.isfinite(s)) if s.size else (np.zeros(0, int), np.zeros(0, int))
            return pd.DataFrame({"query": qs[i], "neighbour": rs[j], "similarity": s[i, j]})

        near = q.groupBy("list", "x", "y").cogroup(r.groupBy("list", "x", "y")).applyInPandas(cell, f"query {kind}, neighbour {kind}, similarity double")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k)

    def recall(self, queries: DataFrame, k: int, probes: int, exact: DataFrame | None = None) -> float:
        """The share of the exact best ``k`` that a search with ``probes`` lists finds."""
        exact = self.search(queries, k) if exact is None else exact
        exact = exact.select("query", "neighbour")
        found = self.search(queries, k, probes).select("query", "neighbour", F.lit(1).alias("hit"))
        return exact.join(found, ["query", "neighbour"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0

    def tuned(self, queries: DataFrame, k: int = 10, target: float = 0.9, seed: int = 7, sample: int = 256) -> int:
        """The least number of probes that reaches the recall on a sample of ``sample`` queries, from one exact search."""
        some = written(queries.where(F.col(self.col).isNotNull()).orderBy(draw(seed, F.col(self.key)), self.key).limit(sample).select(self.key, self.col), "queries")
        exact = written(self.search(some, k), "exact")
        # An exact neighbour is found as soon as its list is probed: its place among the query's lists tells the recall of any number of probes.
        asked = self._nearest(some, len(self.centres)).select(F.col(self.key).alias("query"), "lists")
        places = self.table(queries).select(F.col(self.key).alias("neighbour"), "list")
        found = exact.join(places, "neighbour").join(asked, "query").groupBy(F.array_position("lists", F.col("list")).alias("probes")).agg(F.count(F.lit(1)).alias("n"))
        counts = sorted((r["probes"], r["n"]) for r in found.collect())  # at most as many as centres
        total, so_far = sum(n for _, n in counts), 0
        for probes, n in counts:
            so_far += n
            if so_far / total >= target:
                return int(probes)
        return len(self.centres)
