"""Schemas of the text files that sources read."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW = _strings("TEMPLATE_ID", "TEMPLATE", "VALID", "REACTIONS")
RAW_LABELS = _strings("TEMPLATE", "ECS", "VALID")
GROUPS = _strings("smarts", "reaction_group")
