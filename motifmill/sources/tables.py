"""The driver tables, and the synthetic template table made from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Template rows as SQL that Spark and DuckDB read alike (``lineitem`` has no templates).
TEMPLATE_COLUMNS = """
CAST(l_orderkey AS BIGINT) AS o1, CAST(l_linenumber AS BIGINT) AS o2, CAST(l_partkey AS BIGINT) AS o3, CAST(l_suppkey AS BIGINT) AS o4,
'T' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS TEMPLATE_ID,
CASE WHEN l_partkey % 97 = 0 THEN '[C;H1'
     WHEN l_partkey % 89 = 0 THEN '   '
     ELSE (CASE WHEN l_suppkey % 5 = 0 THEN '[$(C([OH]))]' ELSE '[C;H' || CAST(l_linenumber % 4 AS STRING) || ':1]' END)
       || (CASE l_returnflag WHEN 'A' THEN '-' WHEN 'N' THEN '=' ELSE '#' END)
       || '[N;H' || CAST(l_partkey % 3 AS STRING) || ':' || CAST(l_partkey % 50 AS STRING) || ']>>'
       || (CASE WHEN l_partkey % 11 = 0 THEN 'C%10CC%10' ELSE 'Cl[C,N;H' || CAST(l_suppkey % 4 AS STRING) || ':1]' END)
       || (CASE WHEN l_partkey % 23 = 0 THEN '.(O.N)' ELSE '' END) END AS TEMPLATE,
CASE WHEN l_discount < 0.02 THEN 'False' WHEN l_discount < 0.05 THEN 'True' ELSE 'TRUE' END AS VALID,
CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN '  ' ELSE 'RHEA:' || CAST(l_orderkey % 500 AS STRING) END AS REACTIONS,
CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 17 = 0 THEN ' '
     ELSE ' ' || CAST(1 + l_suppkey % 7 AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey % 20 AS STRING)
       || (CASE WHEN l_linenumber = 2 THEN ';3.5.1.137' ELSE '' END) END AS ECS
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw template rows with the order ``ord``."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_split(TEMPLATE_COLUMNS))
    return rows.select(F.struct("o1", "o2", "o3", "o4").alias("ord"), "TEMPLATE_ID", "TEMPLATE", "VALID", "REACTIONS", "ECS")


def _split(columns: str) -> list[str]:
    """Cuts a select list at its outer commas."""
    out, level, quoted, now = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        level += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not level and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]
