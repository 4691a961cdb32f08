"""Matrices in npy files as a Spark data source: ``spark.read.format("npy")`` and ``df.write.format("npy")``.

A folder holds files of consecutive rows (``part-00000-0000.npy``: float32, two dimensions) and, if
the rows have a key, its values beside each (``.keys.json``).  Reading cuts files into ranges of
bytes, one task for each; single files of other programs are read alike, without keys.  A task
writes files of bounded size into a staging folder; only the commit of the whole job moves them to
their names, and an abort removes them, so a failed task leaves nothing.

Defined cases: rows stay in the order of their tasks; vectors must have one length and no nulls;
an empty table writes no file; an empty folder has no rows.  Register with ``register(spark)``.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "key string, embedding array<float>"
#: Bytes of vectors that a task reads, and that a file holds at most.
RANGE_BYTES, FILE_BYTES = 32 << 20, 64 << 20


def open_fs(uri: str):
    """File system and path of a URI (a plain path is local or a shared mount)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def _header(source) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, element type, and where the data begin."""
    version = np.lib.format.read_magic(source)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(source)
    return shape, fortran, dtype, source.tell()


@dataclass
class Rows(InputPartition):
    path: str
    offset: int
    first: int
    count: int
    dims: int
    dtype: str
    keyed: bool


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        from pyarrow import fs as pafs

        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
        there = {f.path for f in files}
        out = []
        for path in sorted(p for p in there if p.endswith(".npy")):
            with fs.open_input_file(path) as source:
                shape, fortran, dtype, at = _header(source)
            if len(shape) != 2 or fortran or dtype.kind != "f":
                raise ValueError(f"{path}: a matrix of floats by rows is wanted, not {dtype} {shape}")
            rows, dims = shape
            step = max(1, self.range_bytes // max(1, dims * dtype.itemsize))
            keyed = path.removesuffix(".npy") + ".keys.json" in there
            out += [Rows(path, at, k, min(step, rows - k), dims, dtype.str, keyed) for k in range(0, rows, step)]
        return out or [Rows("", 0, 0, 0, 0, "<f4", False)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        p, schema = partition, pa.schema([("key", pa.string()), ("embedding", pa.list_(pa.float32()))])
        if not p.count:
            return
        dtype = np.dtype(p.dtype)
        with fs.open_input_file(p.path) as source:
            source.seek(p.offset + p.first * p.dims * dtype.itemsize)
            raw = source.read(p.count * p.dims * dtype.itemsize)
        values = np.frombuffer(raw, dtype).astype(np.float32)
        keys = [None] * p.count
        if p.keyed:
            with fs.open_input_stream(p.path.removesuffix(".npy") + ".keys.json") as source:
                keys = json.loads(source.read())[p.first : p.first + p.count]
        ends = np.arange(p.count + 1, dtype=np.int32) * p.dims
        vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), vectors], schema=schema)
        for k in range(0, p.count, 4096):
            yield whole.slice(k, 4096)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool, file_bytes: int):
        self.path, self.names, self.overwrite, self.file_bytes = path.rstrip("/"), names, overwrite, file_bytes
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        files: list[str] = []
        rows: list[np.ndarray] = []
        keys: list[str | None] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not rows:
                return
            name = f"{root}/{self.staging}/{uuid.uuid4().hex}"
            fs.create_dir(f"{root}/{self.staging}", recursive=True)
            buffer = io.BytesIO()
            np.save(buffer, np.concatenate(rows))
            with fs.open_output_stream(f"{name}.npy") as sink:
                sink.write(buffer.getvalue())
            if "key" in self.names:
                with fs.open_output_stream(f"{name}.keys.json") as sink:
                    sink.write(json.dumps(keys).encode())
            files.append(name)
            rows.clear()
            keys.clear()
            size = 0

        dims = None
        for batch in (part for whole in iterator for part in self._parts(whole)):
            vectors = batch.column(self.names.index("embedding"))
            lengths = set(vectors.value_lengths().to_pylist())
            dims = dims or next(iter(lengths))
            if vectors.null_count or lengths != {dims}:
                raise ValueError(f"vectors of one length are wanted, not {sorted(map(str, lengths | {dims}))}")
            own = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            rows.append(own)
            keys.extend(batch.column(self.names.index("key")).to_pylist() if "key" in self.names else ())
            size += own.nbytes
            if size >= self.file_bytes:
                flush()
        flush()
        return Written(files)

    def _parts(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parts of a batch that are no larger than a file."""
        if not batch.num_rows:
            return
        dims = max(1, batch.column(self.names.index("embedding")).value_lengths()[0].as_py() or 1)
        some = max(1, self.file_bytes // (4 * dims))
        for k in range(0, batch.num_rows, some):
            yield batch.slice(k, some)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as pafs

        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith((".npy", ".keys.json"))]
        if self.overwrite:
            for path in old:
                fs.delete_file(path)
        first = 0 if self.overwrite else len([p for p in old if p.endswith(".npy")])
        for task, message in enumerate(messages):
            for k, name in enumerate(message.files if message else ()):
                target = f"{root}/part-{first + task:05d}-{k:04d}"
                fs.move(f"{name}.npy", f"{target}.npy")
                if "key" in self.names:
                    fs.move(f"{name}.keys.json", f"{target}.keys.json")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, fs, root: str) -> None:
        from pyarrow import fs as pafs

        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class NpySource(DataSource):
    """Options: path, range_bytes, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        if "embedding" not in schema.names or set(schema.names) - {"key", "embedding"}:
            raise ValueError(f"columns key (if any) and embedding are wanted, not {schema.names}")
        return NpyWriter(self.options["path"], schema.names, overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
