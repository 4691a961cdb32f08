"""A corpus stored by template: tables bucketed and sorted by one key, which joins and keep-first use as they lie.

Every table of a corpus has the same number of buckets, and each bucket is one sorted file, so
joins of two tables and the first row of each key need no exchange, however often they
run.  Tables live in the session's catalog under the name of the corpus, their files in the
shared scratch folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from motifmill.operators.clean import keep_first
from motifmill.scratch import shared_folder

BUCKETS = 64


@dataclass
class Corpus:
    spark: SparkSession
    key: str = "smarts"
    buckets: int = BUCKETS
    name: str = field(default_factory=lambda: f"corpus_{uuid.uuid4().hex[:12]}")

    def store(self, df: DataFrame, table: str) -> DataFrame:
        """Writes a table, once; its rows as they are stored."""
        path = shared_folder(self.spark, table)
        rows = df.repartition(self.buckets, self.key)
        rows.write.format("parquet").option("path", path).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(f"{self.name}_{table}")
        return self.table(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def join(self, left: str, right: str, how: str = "inner") -> DataFrame:
        """Two stored tables by the key: a merge of buckets, neither side is sent anywhere."""
        return self.table(left).join(self.table(right).hint("merge"), self.key, how)

    def first(self, table: str, order: str = "ord") -> DataFrame:
        """The first row of each key of a stored table."""
        return keep_first(self.table(table), self.key, order)

    def drop(self) -> None:
        """Forgets the tables; the scratch files are left to whoever clears that folder."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith(f"{self.name}_"):
                self.spark.sql(f"DROP TABLE {t.name}")
