"""Helpers for column expressions that walk over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold of :func:`text_fold` takes.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates a value once for all its uses in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0, 1, ... below ``n``; empty if that is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def text_fold(parts: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> tuple[Column, Column]:
    """Walks over strings with a count: ``step(count, part)`` gives the next count and a text.

    Returns the last count and all texts joined.  Chunks are folded on their own and then
    joined, so that the work grows with the text and not with its square.
    """
    chunk = lambda k: F.slice(parts, k * CHUNK + 1, CHUNK)
    state = lambda count, text: F.struct(count.cast("int").alias("count"), text.alias("text"))

    def inner(s: Column, part: Column) -> Column:
        count, text = step(s["count"], part)
        return state(count, F.concat(s["text"], text))

    def outer(s: Column, k: Column) -> Column:
        return let(F.aggregate(chunk(k), state(s["count"], F.lit("")), inner), lambda r: state(r["count"], F.concat(s["text"], r["text"])))

    whole = F.aggregate(indices(F.ceil(F.size(parts) / CHUNK).cast("int")), state(F.lit(0), F.lit("")), outer)
    return whole["count"], whole["text"]
