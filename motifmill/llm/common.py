"""Shared pieces: table access, scratch tables in shared storage, words, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifmill.scratch import shared_folder

#: Rows handed to Python in one Arrow batch; texts may be long, so it is small.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20
#: Bytes of text that an operator works on at a time (one text may be longer).
SLICE_BYTES = 4 << 20
#: Spark removes the shuffle files of a finished query when this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that very long texts stay within memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Intermediate tables in the shared folder, so a lost executor costs no lineage.

    The folder is ``spark.checkpoint.dir``; only where the session names none
    (tests, a single machine) a temporary folder is taken.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, shared_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: cuts lineage and frees the shuffles before it."""
        old = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # the written table replaces the shuffle files
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, old)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast, so that the plan is alike at all sizes."""
    return df.hint("merge")


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no operator uses, and the new name of each column: a stage passes any column on."""
    names = {c: f"passed_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def others(names: dict[str, str]) -> tuple[str, ...]:
    """The hidden names of all columns but the id."""
    return tuple(n for c, n in names.items() if c != "doc_id")


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of :func:`hidden` under their own names again."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts have ``most`` bytes together, or are one text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def map_texts(
    df: DataFrame, row: Callable[[], Callable], schema: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One output row per input row, computed from the whole text as UTF-8 bytes.

    ``row()`` is called once in each task and gives a function of a list of texts
    (``bytes``; a null text is ``b""``) that returns the new columns as a list of
    Arrow arrays.  ``keep`` columns are passed through before them.
    """
    arrow_batches(df.sparkSession)
    kept = [id_col, *keep]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("binary").alias("t"))
    out = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + T.StructType.fromDDL(schema).fields)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, len(kept)):
                work = work or row()
                texts = [x or b"" for x in part.column(len(kept)).to_pylist()]
                columns = [part.column(i) for i in range(len(kept))] + work(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, out)


# --- words and hashes -------------------------------------------------------

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> _S30)) * M2
    x = (x ^ (x >> _S27)) * M3
    return x ^ (x >> _S31)


class WordHashes:
    """64-bit hashes of words, kept for reuse up to a bound (memory stays bounded)."""

    def __init__(self, limit: int = 400_000, digest: Callable[[bytes], int] | None = None):
        import xxhash

        self._digest, self._limit, self._seen = digest or xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen, digest = self._seen, self._digest
        if len(seen) > self._limit:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in seen:
                    seen[w] = digest(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def crc_text(col) -> "F.Column":
    """crc32 of an id written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def crc_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text in DuckDB, which has no such function."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"
