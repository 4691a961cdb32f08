"""Grammar tokenizer as a column expression, brackets matched at any depth."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions.fold import text_fold

DEPTH = 8
#: Characters of a text that the nested pattern takes at most.
LONG = 1000

# Fixed values of the grammar outside brackets; the first alternative that matches wins.
PLAIN = (
    ">>",
    "Cl|Br",
    "[BCNOPSFIbcnopsAa*]",
    r"/\?|\\\?",
    r"[-=#~:@/\\]",
    "[()]",
    r"\.",
    "%[0-9]{2}",
    "[0-9]",
    "[!&,;]",
    ">",
)


def pattern(depth: int = DEPTH) -> str:
    """One pattern for all tokens, brackets nested up to ``depth`` times."""
    plain = r"[^\[\]]*"
    inside = plain
    for _ in range(depth - 1):
        inside = rf"{plain}(?:\[{inside}\]{plain})*"
    return "|".join([rf"\[{inside}\]", *PLAIN])


PATTERN = pattern()


def tokens(col: Column) -> Column:
    """The tokens of a string; complete only where :func:`tokenizes` holds."""
    return F.regexp_extract_all(col, F.lit(PATTERN), F.lit(0))


def covers(col: Column, parts: Column) -> Column:
    """Whether the tokens make up the whole string."""
    return F.length(F.array_join(parts, "")) == F.length(col)


def tokenizes(col: Column) -> Column:
    return F.coalesce(covers(col, tokens(col)), F.lit(False))


_PLAIN = re.compile("|".join(PLAIN))


def scan(text: str) -> list[str]:
    """Tokens at any nesting depth; ``ValueError`` where the grammar has none."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "[":
            level, end = 0, at
            while end < len(text):
                level += (text[end] == "[") - (text[end] == "]")
                end += 1
                if level == 0:
                    break
            if level:
                raise ValueError(f"{text!r} opens a bracket at {at} that stays open: Unmatched")
        else:
            m = _PLAIN.match(text, at)
            if m is None:
                raise ValueError(f"{text!r} has no token at {at}: Unexpected character {text[at]!r}")
            end = m.end()
        out.append(text[at:end])
        at = end
    return out


# Stand for brackets inside brackets while a string is cut; the mark itself is escaped alike.
MARK = "\ue000"
_INNER = ((MARK, MARK + "0"), ("[", MARK + "1"), ("]", MARK + "2"))
FLAT = pattern(1)


def _flat(text: Column) -> Column:
    """The string with the brackets inside brackets marked; null if they do not match."""
    escaped = F.replace(text, F.lit(MARK), F.lit(_INNER[0][1]))
    pieces = F.regexp_extract_all(escaped, F.lit(r"[\[\]]|[^\[\]]+"), F.lit(0))

    def step(depth: Column, piece: Column) -> tuple[Column, Column]:
        # A depth below 0 stays there: the string closes what was never open.
        after = F.when(depth < 0, depth).when(piece == "[", depth + 1).when(piece == "]", depth - 1).otherwise(depth)
        inner = F.when((piece == "[") & (depth > 0), _INNER[1][1]).when((piece == "]") & (depth > 1), _INNER[2][1]).otherwise(piece)
        return after, inner

    depth, flat = text_fold(pieces, step)
    return F.when(depth == 0, flat)


def deep_tokens(text: Column) -> Column:
    """The tokens at any nesting depth: brackets are matched by their running depth."""

    def unmarked(token: Column) -> Column:
        for plain, marked in reversed(_INNER):
            token = F.replace(token, F.lit(marked), F.lit(plain))
        return token

    return F.transform(F.regexp_extract_all(_flat(text), F.lit(FLAT), F.lit(0)), unmarked)


def with_tokens(df: DataFrame, col: str, out: str = "tokens", ok: str = "ok") -> DataFrame:
    """Adds the tokens and whether the string tokenizes (else no tokens).

    One pattern does nearly all rows; only long texts, whose brackets it would match by
    recursion, and texts it cannot cover that hold more brackets than its depth are cut by running
    depth, in the same expression.  It is run once a row: it names the partition, so that the
    optimiser does not copy it into filters on the tokens and these do not sink below what made
    the rows distinct.
    """
    text = F.col(col)
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    long = F.length(text) > LONG
    deep = long | (F.length(text) - F.length(F.replace(text, F.lit("["))) > DEPTH)
    shallow = df.withColumn("_t", once(F.when(~long, tokens(text))))
    full = F.coalesce(covers(text, F.col("_t")), F.lit(False))
    parts = F.when(full, F.col("_t")).when(deep, deep_tokens(text))
    tried = shallow.withColumn("_t", once(parts))
    good = F.coalesce(covers(text, F.col("_t")), F.lit(False))
    return tried.withColumn(ok, good).withColumn(out, F.when(F.col(ok), F.col("_t")).otherwise(F.array().cast("array<string>"))).select(*[c for c in df.columns if c not in (out, ok)], out, ok)
