"""Token ids in binary shard files: one zstandard frame per document, one shared dictionary.

Texts are encoded with a public byte-level BPE vocabulary (tokenizers library), the end
id is appended, and documents are written in ascending id order.  A shard file is

    magic 8 | sha256 of the dictionary 32 | frame of each document ... |
    index: ids int64[n], id present uint8[n], offsets uint64[n + 1], tokens uint64[n] |
    index offset uint64 | n uint64 | magic 8

(little endian); a frame holds the ids as unsigned 32-bit integers.  The dictionary is
trained on serialised id arrays of a bounded sample (the first ``sample_chars`` characters of
the ``sample_docs`` documents with the smallest hash of their id) and stored once beside the shards, under its hash; a reader
refuses a shard of another dictionary.  ``ShardReader.get(k)`` reads the index and one
frame, so that short documents are reached without reading the rest.

Scale: one shuffle of the texts by ranges of ids, whose bounds come from a bounded sample of ids
alone; an id that fills several ranges is dealt to all their tasks row by row, whatever its
texts are; files are written and read by the executors
through the file system of the scratch URI, each under a name of its own, and only the
manifest of the tasks that succeeded counts: lost executors leave at most unused files.
A shard holds about ``shard_bytes`` of text; a task writes one shard after another, and there
are at most ``MAX_TASKS`` tasks at any size.

Defined cases: null text is empty (the end id alone); null ids come first; equal ids are
ordered by text, those dealt to several tasks within each; very long texts are one frame; an empty table writes no shard; extra columns are ignored.  Ids must be
integers.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifmill.llm import common

MAGIC = b"MMIDS\x00\x00\x01"
END_ID = 2
LEAST = -(2**63)
#: Tasks that write or read files, and sampled ids for each of them that the ranges are cut by.
MAX_TASKS, SAMPLED = 20_000, 100
#: Bounds that are compared with an id one by one.
STEP = 128
_TWO_SPACES = re.compile(r"\s\s")


class CachedEncoder:
    """Ids of whole texts as little-endian bytes, by space-delimited chunks that are kept.

    A pre-token of this vocabulary starts at a single space or line feed between visible
    characters, so a text without runs of white space can be encoded chunk by chunk.
    Other texts, and texts with special tokens, go to the library whole.  The first
    ``limit`` chunks are kept, which are the frequent ones; others are encoded each time.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.split, self.model, self.limit = self.whole.pre_tokenizer, self.whole.model, limit
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.first: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}
        self.space = self.split.pre_tokenize_str(" ")[0][0]
        self.marks = {c: self._piece(self.split.pre_tokenize_str(c)[0][0]) for c in ".,"}
        self.feed = self._library("\n")

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, word: str, space: str) -> bytes:
        if word.isascii():  # ASCII letters are one pre-token, a mark after them another
            if word.isalpha():
                return self._piece((self.space if space else "") + word)
            if word[-1:] in self.marks and word[:-1].isalpha():
                return self._piece((self.space if space else "") + word[:-1]) + self.marks[word[-1]]
        return b"".join(self._piece(piece) for piece, _ in self.split.pre_tokenize_str(space + word))

    def _rare(self, words: list[str]) -> list[bytes]:
        out, spaced = [], self.spaced
        for w in words:
            ids = spaced.get(w)
            if ids is None:
                ids = self._chunk(w, " ")
                if len(spaced) < self.limit:
                    spaced[w] = ids
            out.append(ids)
        return out

    def __call__(self, text: str) -> bytes:
        if _TWO_SPACES.search(text) or any(s in text for s in self.special):
            return self._library(text)
        out, spaced = [], self.spaced
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            ids = self.first.get(head)
            if ids is None:
                ids = self._chunk(head, "")
                if len(self.first) < self.limit // 4:
                    self.first[head] = ids
            try:
                out.append(ids + b"".join([spaced[w] for w in rest]))
            except KeyError:
                out.append(ids + b"".join(self._rare(rest)))
        return self.feed.join(out)


def open_fs(uri: str):
    """File system and path of a folder URI (a plain path is a shared mount)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def train_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A trained dictionary; where the sample is too small to train on, its own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) + bytes(8))[-size:] if samples else bytes(8)


class ShardWriter:
    def __init__(self, sink, dictionary: bytes, level: int = 3):
        import zstandard

        self.sink = sink
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        self.ids: list[int] = []
        self.present: list[int] = []
        self.sizes: list[int] = []
        self.offsets = [len(MAGIC) + 32]
        sink.write(MAGIC + hashlib.sha256(dictionary).digest())

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.sink.write(frame)
        self.ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.sizes.append(len(ids) // 4)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> None:
        n = len(self.ids)
        parts = (np.array(self.ids, "<i8"), np.array(self.present, "u1"), np.array(self.offsets, "<u8"), np.array(self.sizes, "<u8"), np.array([self.offsets[-1], n], "<u8"))
        self.sink.write(b"".join(p.tobytes() for p in parts) + MAGIC)


class ShardReader:
    """Random access to the documents of one shard; ``source`` is a seekable file."""

    def __init__(self, source, dictionary: bytes):
        import zstandard

        self.source = source
        source.seek(0)
        head = source.read(len(MAGIC) + 32)
        end = source.seek(0, 2)
        source.seek(end - len(MAGIC) - 16)
        foot = source.read()
        if head[: len(MAGIC)] != MAGIC or foot[16:] != MAGIC:
            raise ValueError("not a shard of token ids")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at, n = (int(x) for x in np.frombuffer(foot[:16], "<u8"))
        source.seek(at)
        index = source.read(n * 25 + 8)
        self.ids = np.frombuffer(index, "<i8", n)
        self.present = np.frombuffer(index, "u1", n, n * 8).astype(bool)
        self.offsets = np.frombuffer(index, "<u8", n + 1, n * 9)
        self.sizes = np.frombuffer(index, "<u8", n, n * 17 + 8)
        self._expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def __len__(self) -> int:
        return len(self.ids)

    def get(self, k: int) -> bytes:
        """The ids of the k-th document, as bytes."""
        first, past = int(self.offsets[k]), int(self.offsets[k + 1])
        self.source.seek(first)
        out = self._expand(self.source.read(past - first))
        if len(out) != 4 * int(self.sizes[k]):
            raise ValueError(f"document {k} is damaged")
        return out


def _bounds(ids: DataFrame, n_rows: int, tasks: int) -> list[int]:
    """Ids that cut the rows into ``tasks`` ranges of about equal size; one that fills several ranges occurs again."""
    if tasks < 2:
        return []
    share = min(1.0, SAMPLED * tasks / max(1, n_rows))
    some = sorted(r["i"] for r in (ids.sample(share, 42) if share < 1 else ids).collect())  # SAMPLED ids a task, about
    return [some[len(some) * k // tasks] for k in range(1, tasks)] if some else []


def _range(key, bounds: list[int]):
    """The range of an id; rows of an id that fills whole ranges go to any of those."""
    if not bounds:
        return F.lit(0)
    array = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), kind)
    heads = array(bounds[::STEP], "array<bigint>")
    parts = array([bounds[k : k + STEP] for k in range(0, len(bounds), STEP)], "array<array<bigint>>")

    def before(less):
        block = F.size(F.filter(heads, less))
        return F.when(block > 0, (block - 1) * STEP + F.size(F.filter(F.get(parts, block - 1), less))).otherwise(0)

    low, high = before(lambda b: b < key), before(lambda b: b <= key)
    spread = F.pmod(F.monotonically_increasing_id(), (high - low + 1).cast("bigint")).cast("int")
    return F.when(high - low > 1, low + spread).otherwise(low).cast("int")


def write_token_files(docs: DataFrame, tokenizer: str, scratch: common.Scratch, end_id: int = END_ID, shard_bytes: int = 16 << 20, sample_docs: int = 1000, sample_chars: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the shards; the manifest (shard, path, n_docs, n_tokens) and the path of the dictionary."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    n_rows = rows.count()
    ending = np.array([end_id], "<u4").tobytes()

    encoder = CachedEncoder(tokenizer)
    few = rows.select(F.xxhash64("i").alias("h"), "i").orderBy("h", "i").limit(sample_docs).select("i").distinct()
    texts = rows.join(F.broadcast(few), "i", "left_semi").select(F.substring("t", 1, sample_chars).alias("t"), F.octet_length("t").alias("size"))
    texts = texts.orderBy(F.xxhash64("t"), "t").limit(2 * sample_docs).collect()  # more where ids repeat
    dictionary = train_dictionary(sorted(encoder(r["t"]) + ending for r in texts))
    total = n_rows * (sum(r["size"] for r in texts) / max(1, len(texts)))  # about the bytes of all texts
    folder = scratch.path("ids")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    name = f"dictionary-{hashlib.sha256(dictionary).hexdigest()[:16]}.zdict"
    with fs.open_output_stream(f"{root}/{name}") as sink:
        sink.write(dictionary)

    # The encoder of a Python worker is kept in its copy of the broadcast value.
    kept = spark.sparkContext.broadcast({"path": tokenizer})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kept.value
        task, shard, writer, sink = TaskContext.get().partitionId(), 0, None, None
        own, base = open_fs(folder)

        def finished() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"task": [task], "shard": [shard], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.sizes)]})

        for batch in batches:
            for part in common.slices(batch, 1):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if writer is None:
                        if "encoder" not in state:
                            state["encoder"] = CachedEncoder(state["path"])
                        path = f"{base}/shard-{task:08d}-{shard:06d}-{uuid.uuid4().hex}.ids"
                        sink, size = own.open_output_stream(path), 0
                        writer = ShardWriter(sink, dictionary)
                    writer.add(i, state["encoder"](t) + ending)
                    size += len(t)
                    if size >= shard_bytes:
                        yield finished()
                        writer, shard = None, shard + 1
        if writer is not None:
            yield finished()

    tasks = min(MAX_TASKS, max(1, math.ceil(total / shard_bytes)))
    key = F.coalesce("i", F.lit(LEAST))
    bounds = _bounds(rows.select(key.alias("i")), n_rows, tasks)
    ordered = rows.repartitionById(len(bounds) + 1, _range(key, bounds)).sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
    manifest = scratch.write(ordered.mapInArrow(write, "task bigint, shard bigint, path string, n_docs bigint, n_tokens bigint"), "manifest")
    return manifest, f"{folder}/{name}"


def read_token_files(manifest: DataFrame, dictionary_path: str) -> DataFrame:
    """Per document, from the files: id, tokens before it, its tokens, crc32 of its ids."""
    folder, _, name = dictionary_path.rpartition("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        dictionary = None
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if dictionary is None:
                    with fs.open_input_stream(f"{root}/{name}") as source:
                        dictionary = source.read()
                with fs.open_input_file(path) as source:
                    shard = ShardReader(source, dictionary)
                    sizes = shard.sizes.astype(np.int64)
                    starts = before + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    sums = [zlib.crc32(shard.get(k)) for k in range(len(shard))]
                    columns = [pa.array(shard.ids, mask=~shard.present), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # Running totals inside each task's files, and over the tasks, of which there are few.
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n_tokens")).select("task", earlier(W.orderBy("task")).alias("tasks_before"))
    shards = manifest.withColumn("inside", earlier(W.partitionBy("task").orderBy("shard"))).join(F.broadcast(tasks), "task")
    shards = shards.select("path", (F.col("tasks_before") + F.col("inside")).alias("before"))
    parts = min(MAX_TASKS, max(1, manifest.count()))
    return shards.repartition(parts).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    manifest, dictionary = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), common.Scratch(spark, "token_files"))
    return read_token_files(manifest, dictionary)
