"""Blank-aware predicates; plain ``trim`` knows only U+0020."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a string.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Without outer white space of any kind (only the ends are looked at, no pattern)."""
    return F.btrim(col, F.lit(WHITE))


def not_blank(col: Column) -> Column:
    return col.isNotNull() & (strip(col) != "")


def is_true(col: Column) -> Column:
    """``TRUE`` in any case, as text or boolean; null is not true."""
    return F.coalesce(F.upper(col.cast("string")) == "TRUE", F.lit(False))
