"""Enzyme class prefixes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifmill.functions.text import strip


def primary_ec(col: Column, depth: int = 1) -> Column:
    """The first ``depth`` parts of the first class listed; null if that is blank."""
    if depth < 1:
        raise ValueError("depth is at least 1")
    first = strip(F.get(F.split(col, ";"), F.lit(0)))
    return F.substring_index(F.nullif(first, F.lit("")), ".", depth)


def top_level(col: Column) -> Column:
    """The part before the first dot of the first class listed, unstripped."""
    return F.substring_index(F.substring_index(col, ";", 1), ".", 1)
