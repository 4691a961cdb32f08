"""Span masks for masked-language modelling, as column expressions.

Random numbers are counters, not states: the md5 of seed, epoch, row key and turn (or position)
gives four 32-bit draws, so masks do not depend on partitions and other engines can
follow them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions.fold import indices, let

# Fixed values.
SPECIALS = ("[PAD]", "[UNK]", "[BOS]", "[EOS]")
STRUCTURAL = ("(", ")", ".", ">>", ">")
MASK, IGNORE = "[MASK]", -100

#: What becomes of a masked position.
PADDED, FREE, HIDDEN, RANDOM, SAME = -1, 0, 1, 2, 3
WORD = 1 << 32


@dataclass
class SpanMasker:
    """Masks spans until a share of the real positions is used up.

    Span lengths are geometric with the given mean and a cap; each span becomes the mask
    id (80 in 100), random ids (10) or stays as it is (10).  A mask token that is already
    in the vocabulary is neither drawn at random nor content.
    """

    token_to_id: Mapping[str, int]
    share: float = 0.25
    mean_span: float = 3.0
    max_span: int = 10
    mask_id: int = field(init=False)
    extended_size: int = field(init=False)

    def __post_init__(self) -> None:
        known = self.token_to_id
        kinds = {t: "mask" if t == MASK else "special" if t in SPECIALS else "structural" if t in STRUCTURAL else "content" for t in known}
        of = lambda *wanted: [i for t, i in known.items() if kinds[t] in wanted]
        self.content_ids = frozenset(of("content"))
        self.random_ids = of("content", "structural")
        own = of("mask")
        self.mask_id, self.extended_size = (own[0], len(known)) if own else (len(known), len(known) + 1)

    def budget(self, real: Column) -> Column:
        """Positions to mask of so many real ones: the share, rounded half to even, one at least."""
        return F.when(real > 0, F.greatest(F.lit(1), F.bround(F.lit(self.share) * real))).otherwise(0).cast("int")

    def longer(self) -> list[int]:
        """Bounds of a 32-bit draw: the span is one longer for each bound above the draw."""
        go_on = 1 - 1 / self.mean_span
        return [int(WORD * go_on**k) for k in range(1, self.max_span)]

    def kinds(self, mask: Column, key: Column, seed: int, epoch: int) -> Column:
        """What becomes of each position, span after span."""
        real = F.transform(mask, lambda x: F.when(x == 1, FREE).otherwise(PADDED))
        longer, hidden, random = self.longer(), int(WORD * 0.8), int(WORD * 0.9)

        def turn(state: Column, t: Column) -> Column:
            def span(x: Column) -> Column:
                free, h = x["free"], x["h"]
                at = F.get(free, (_draw(h, 0) % F.size(free)).cast("int"))
                length = F.size(F.filter(F.array(*[F.lit(b) for b in longer]), lambda b: _draw(h, 1) < b)) + 1 if longer else F.lit(1)
                kind = F.when(_draw(h, 2) < hidden, HIDDEN).when(_draw(h, 2) < random, RANDOM if self.random_ids else SAME).otherwise(SAME)
                return let(F.struct(at.alias("at"), (at + length).alias("end"), kind.alias("kind")), lambda s: chosen(free, s))

            def chosen(free: Column, s: Column) -> Column:
                own = F.slice(F.filter(free, lambda p: (p >= s["at"]) & (p < s["end"])), 1, state["left"])
                return let(own, lambda w: F.struct(F.transform(state["kinds"], lambda k, i: F.when(F.array_contains(w, i), s["kind"]).otherwise(k)).alias("kinds"), (state["left"] - F.size(w)).alias("left")))

            free = F.filter(indices(F.size(state["kinds"])), lambda p: F.get(state["kinds"], p) == FREE)
            found = let(F.struct(free.alias("free"), _digest(seed, epoch, key, t).alias("h")), span)
            return F.when((state["left"] > 0) & F.exists(state["kinds"], lambda k: k == FREE), found).otherwise(state)

        n = F.size(F.filter(mask, lambda x: x == 1))
        start = F.struct(real.alias("kinds"), self.budget(n).alias("left"))
        return F.aggregate(indices(self.budget(n)), start, turn, lambda s: s["kinds"])


def _digest(seed: int, epoch: int, key: Column, *more: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), key.cast("string"), *[m.cast("string") for m in more]).cast("binary"))


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint")


def span_mask(df: DataFrame, masker: SpanMasker, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Replaces ``input_ids`` by masked ids and adds ``labels``; one row per sequence, padding stays.

    A sequence without real positions is left as it is; rows with one key are masked alike.
    """
    kinds = masker.kinds(F.col("attention_mask"), F.col(key), seed, epoch)
    random = F.from_json(F.lit(json.dumps(masker.random_ids)), "array<bigint>")
    at_random = lambda i: F.get(random, (_draw(_digest(seed, epoch, F.col(key), F.lit("at"), i), 0) % max(1, len(masker.random_ids))).cast("int"))
    rows = df.withColumn("_kinds", F.when(F.spark_partition_id() >= 0, kinds))  # evaluated once a row
    kind = lambda i: F.get("_kinds", i)
    labels = F.transform("input_ids", lambda x, i: F.when(kind(i) > FREE, x).otherwise(F.lit(IGNORE).cast("bigint")))
    ids = F.transform("input_ids", lambda x, i: F.when(kind(i) == HIDDEN, F.lit(masker.mask_id).cast("bigint")).when(kind(i) == RANDOM, at_random(i)).otherwise(x))
    return rows.withColumn("labels", labels).withColumn("input_ids", ids).select(*[c for c in df.columns if c != "labels"], "labels")
