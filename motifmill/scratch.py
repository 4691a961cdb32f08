"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders that this driver has named, in order.
_NAMED: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session without it takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="motifmill-")
    _NAMED.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _NAMED[-1]


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Removes the folders named inside: for steps whose result is stored elsewhere by then."""
    first = len(_NAMED)
    try:
        yield
    finally:
        own = _NAMED[first:]
        del _NAMED[first:]
        for folder in own:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table, read back: made once however often they are used, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
