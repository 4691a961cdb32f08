"""Structure counts of reaction templates from their tokens.

Sides are split at the arrow (``>>`` or two ``>`` with agents between, which do not
count).  Templates of a side are its runs between dots outside parentheses; atoms are
bracket and bare atom tokens; bonds are atoms less fragments plus ring closures.  A
string is valid if it tokenizes, has one arrow, balanced parentheses, an even number of
uses of each ring label on a side, and atoms on both sides.  Side strings are the raw
text; no canonical form is made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifmill.functions.fold import let

ATOM = r"^(?:\[.*|Cl|Br|[BCNOPSFIbcnopsAa*])$"
RING = r"^(?:%[0-9]{2}|[0-9])$"


def _count(parts: Column, keep) -> Column:
    return F.size(F.filter(parts, keep))


def _templates(parts: Column) -> Column:
    """One more than the dots at parenthesis depth 0; -1 if parentheses do not balance."""

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        return F.struct(
            depth.alias("depth"),
            (s["dots"] + F.when((x == ".") & (s["depth"] == 0), 1).otherwise(0)).alias("dots"),
            (s["bad"] | (depth < 0)).alias("bad"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("dots"), F.lit(False).alias("bad"))
    return F.aggregate(parts, start, step, lambda s: F.when(s["bad"] | (s["depth"] != 0), F.lit(-1)).otherwise(s["dots"] + 1))


def _side(parts: Column) -> Column:
    atoms, dots = _count(parts, lambda x: x.rlike(ATOM)), _count(parts, lambda x: x == ".")

    def fields(rings: Column) -> Column:
        odd = F.exists(F.array_distinct(rings), lambda r: F.size(F.filter(rings, lambda x: x == r)) % 2 == 1)
        return F.struct(
            F.array_join(parts, "").alias("text"),
            _templates(parts).alias("templates"),
            atoms.alias("atoms"),
            (atoms - (dots + 1) + F.floor(F.size(rings) / 2)).cast("int").alias("bonds"),
            odd.alias("odd"),
        )

    return let(F.filter(parts, lambda x: x.rlike(RING)), fields)


def structure(tokens: Column, ok: Column) -> Column:
    """A struct of the validation fields; all but ``valid`` are null if it is false."""
    return let(F.struct(tokens.alias("t"), ok.alias("ok")), lambda x: _structure(x["t"], x["ok"]))


def _structure(tokens: Column, ok: Column) -> Column:
    arrows = _count(tokens, lambda x: x == ">>")
    lone = _count(tokens, lambda x: x == ">")
    n = F.size(tokens)
    first = F.when(arrows == 1, F.array_position(tokens, ">>")).otherwise(F.array_position(tokens, ">")).cast("int")
    last = F.when(arrows == 1, first).otherwise(n + 1 - F.array_position(F.reverse(tokens), ">").cast("int"))
    shaped = ok & (((arrows == 1) & (lone == 0)) | ((arrows == 0) & (lone == 2)))
    safe = F.when(shaped, tokens).otherwise(F.array(F.lit(">>")))
    f, k = F.when(shaped, first).otherwise(F.lit(1)), F.when(shaped, last).otherwise(F.lit(1))
    left, right = F.slice(safe, 1, f - 1), F.slice(safe, k + 1, F.size(safe))

    def fields(sides: Column) -> Column:
        a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        valid = shaped & (a["templates"] > 0) & (b["templates"] > 0) & ~a["odd"] & ~b["odd"] & (a["atoms"] > 0) & (b["atoms"] > 0)
        only = lambda c: F.when(valid, c)
        return F.struct(
            valid.alias("valid"),
            only(a["text"]).alias("reactant_smarts"),
            only(b["text"]).alias("product_smarts"),
            only(a["templates"]).alias("n_reactant_templates"),
            only(b["templates"]).alias("n_product_templates"),
            only(a["atoms"] + b["atoms"]).alias("n_atoms"),
            only(a["bonds"] + b["bonds"]).alias("n_bonds"),
        )

    return let(F.transform(F.array(left, right), _side), fields)
