"""Merkle manifest of a dataset: a digest for every row, one root, and a proof for every row.

A leaf is the sha256 of a row's columns, each as byte count, colon and value (``-`` if null).
Within a group (a source) leaves ascend by key; every ``FANOUT`` consecutive nodes become one,
until one is left, the group's subroot; subroots, ordered by group, become the root alike.

Superblock reduction: nodes are bucketed by ``index div FANOUT^LEVELS``; ``applyInPandas``
collapses LEVELS levels of a bucket at once; bucket roots are the nodes of the next round.
On the way back each bucket meets the proof of its own root, and its nodes' proofs are their
siblings below the bucket root followed by that.  A bucket is 256 nodes at most, however many
rows a group has; rounds grow with the logarithm of the largest group.  Only digests are
shuffled, never texts.

Defined cases: a null key, group or column is written ``-`` and comes first in its order; an
empty text has the field ``0:``; texts of any length are hashed whole; rows with one key
are ordered by their digests, so repeated rows are leaves of their own; an empty table gives no
row; columns beside those named are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import common
from motifmill.llm.ordering import numbered

FANOUT = 16
#: Levels that one round collapses; a bucket has FANOUT^LEVELS nodes.
LEVELS = 2
BUCKET = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row; numbers are written in decimals."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def collapse(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels above some nodes: LEVELS of them, or, if they are a whole group, until one node is left."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([digest("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """The siblings of a node up to the top of its levels: those on its left, those on its right, level by level."""
    out = []
    for level in levels[:-1]:
        first = at - at % FANOUT
        out += ["".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])]
        at //= FANOUT
    return out


def fold(node: str, proof: Sequence[str]) -> str:
    """The root that a node and its proof (left and right siblings in turn) lead to."""
    for left, right in zip(proof[::2], proof[1::2], strict=True):
        node = digest(left + node + right)
    return node


def _buckets(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (g, i, n, h) and what they carry as one row for each bucket, with the root of its levels."""
    kinds = ", ".join(f"`{c}` array<{nodes.schema[c].dataType.simpleString()}>" for c in carried)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        hs, n = rows["h"].tolist(), int(rows["n"].iloc[0])
        top = collapse(hs, n <= BUCKET)[-1][0]
        lists = [[None if pd.isna(x) else x for x in rows[c].astype(object)] for c in carried]
        return pd.DataFrame([[key[0], int(key[1]), n, top, hs, *lists]], columns=["g", "b", "n", "top", "hs", *carried])

    grouped = nodes.withColumn("b", F.expr(f"i div {BUCKET}")).groupBy("g", "b")
    return grouped.applyInPandas(one, f"g string, b bigint, n bigint, top string, hs array<string>{', ' if kinds else ''}{kinds}")


def rounds(nodes: DataFrame, carried: list[str], scratch: common.Scratch, name: str) -> list[DataFrame]:
    """The buckets of every round, lowest first."""
    out: list[DataFrame] = []
    while True:
        out.append(scratch.write(_buckets(nodes, [] if out else carried), f"{name}-{len(out)}"))
        most = out[-1].agg(F.max("n")).first()[0]
        if not most or most <= BUCKET:
            return out
        nodes = out[-1].where(f"n > {BUCKET}").select("g", F.col("b").alias("i"), F.expr(f"cast(ceil(n / {BUCKET}) as bigint)").alias("n"), F.col("top").alias("h"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, top): the last node of every group."""
    out = None
    for df in levels:
        done = df.where(f"n <= {BUCKET}").select("g", "top")
        out = done if out is None else out.unionByName(done)
    return out


def meet(levels: list[DataFrame], crown: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """The lowest buckets, each with the proof (up) of its own root; ``crown`` (g, up, subroot) has that of every group's top."""
    paths, met = None, None
    for r in reversed(range(len(levels))):
        own = levels[r].where(f"n <= {BUCKET}").join(crown, "g")
        met = own if paths is None else own.unionByName(levels[r].where(f"n > {BUCKET}").join(paths, ["g", "b"]).select(*own.columns))
        if r:
            paths = scratch.write(met.select("g", "n", "hs", "b", "up", "subroot").mapInArrow(_node_paths, "g string, b bigint, up array<string>, subroot string"), f"{name}-up-{r}")
    return met


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[list[str]]]]:
    """Bucket by bucket, its row and the whole proofs of its nodes."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            levels = collapse(r["hs"], r["n"] <= BUCKET)
            yield r, [siblings(levels, at) + r["up"] for at in range(len(r["hs"]))]


def _node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r, ups in _proofs(batches):
        yield pa.RecordBatch.from_pydict({"g": [r["g"]] * len(ups), "b": [r["b"] * BUCKET + k for k in range(len(ups))], "up": pa.array(ups, pa.list_(pa.string())), "subroot": [r["subroot"]] * len(ups)})


def manifest(docs: DataFrame, scratch: common.Scratch, key: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS, altered: dict[str, Column] | None = None, proofs: bool = False) -> DataFrame:
    """One row for each row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``altered`` replaces columns in the leaf that is folded with the proof (what a reader holds
    now), while tree and proofs stay those of ``docs``.  With ``proofs`` the siblings themselves
    follow as ``proof`` (left and right in turn, see :func:`fold`).
    """
    common.arrow_batches(docs.sparkSession)
    now = {c: F.col(f"`{c}`") for c in columns}
    held = [(altered or {}).get(c, now[c]) for c in columns]
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # nulls first
    nodes = docs.select(name.alias("g"), F.col(f"`{key}`").alias("o"), leaf(list(now.values())).alias("h"), leaf(held).alias("a"))
    nodes = nodes.withColumn("a", F.nullif("a", "h"))
    nodes = numbered(nodes, "g", ["o", "h", "a"], scratch, "leaves").withColumn("k", F.col("o").cast("string"))
    low = rounds(nodes, ["k", "a"], scratch, "low")
    subroots = tops(low).select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("top").alias("h"))
    high = rounds(numbered(subroots, "g", ["k"], scratch, "subroots"), ["k"], scratch, "high")
    root = tops(high).first()
    root = root["top"] if root else None

    def crowns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ups in _proofs(batches):
            yield pa.RecordBatch.from_pydict({"g": r["k"], "up": pa.array(ups, pa.list_(pa.string())), "subroot": r["hs"]})

    top = high[-1].select("g").distinct().select("g", F.array().cast("array<string>").alias("up"), F.lit(root).cast("string").alias("subroot"))
    crown = meet(high, top, scratch, "high").select("n", "hs", "k", "up").mapInArrow(crowns, "g string, up array<string>, subroot string")
    crown = scratch.write(crown, "crown")
    met = meet(low, crown, scratch, "low")
    fields = "k string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ups in _proofs(batches):
            folded = [fold(a or h, up) for h, a, up in zip(r["hs"], r["a"], ups, strict=True)]
            m = len(ups)
            out = {"k": pa.array(r["k"], pa.string()), "leaf": r["hs"], "subroot": [r["subroot"]] * m, "root": [root] * m}
            out |= {"proof_sha256": [digest("".join(up)) for up in ups], "folded_root": folded, "verified": [f == root for f in folded]}
            yield pa.RecordBatch.from_pydict(out | ({"proof": pa.array(ups, pa.list_(pa.string()))} if proofs else {}))

    out = met.select("n", "hs", "k", "a", "up", "subroot").mapInArrow(rows, fields)
    return out.select(F.col("k").cast(docs.schema[key].dataType).alias(key), *out.columns[1:])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by source; where 5 divides the crc32 of an id, the text held now is in lower case."""
    docs = common.table(spark, sf_dir, "documents")
    changed = F.when(common.crc_text(F.col("doc_id")) % 5 == 0, lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, common.Scratch(spark, "merkle"), altered={"text": changed})


def _sql(depth: int = 8, high: int = 4) -> str:
    """The same in SQL: ``depth`` levels of 16 for a source, ``high`` for the subroots."""
    field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    row = "sha256(" + " || ".join(field.format(c) for c in COLUMNS[:-1]) + " || {0})"
    crc = common.crc_sql("CAST(doc_id AS VARCHAR)")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {row.format(field.format('text'))} AS h,
  CASE WHEN {crc} % 5 = 0 THEN {row.format(field.format(low))} ELSE {row.format(field.format('text'))} END AS a FROM documents)""",
        "l0 AS (SELECT doc_id, g, h AS leaf, a AS f, h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, a) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, '' AS p FROM d)",
    ]

    def level(src: str, out: str, keep: str) -> list[str]:
        return [
            f"{out}r AS (SELECT g, i // 16 AS b, list(h ORDER BY i) AS r FROM (SELECT DISTINCT g, i, h FROM {src}) GROUP BY ALL)",
            f"""{out} AS (SELECT {keep}, CASE WHEN n > 1 THEN sha256(array_to_string(r, '')) ELSE h END AS h, i // 16 AS i, CAST(ceil(n / 16.0) AS BIGINT) AS n,
  CASE WHEN n > 1 THEN sha256(array_to_string(list_concat(r[1:i % 16], [f], r[i % 16 + 2:]), '')) ELSE f END AS f,
  CASE WHEN n > 1 THEN p || array_to_string(list_concat(r[1:i % 16], r[i % 16 + 2:]), '') ELSE p END AS p
  FROM {src} s JOIN {out}r ON s.g = {out}r.g AND s.i // 16 = {out}r.b)""",
        ]

    for k in range(depth):
        parts += level(f"l{k}", f"l{k + 1}", "doc_id, s.g, leaf")
    parts.append(f"t0 AS (SELECT doc_id, '' AS g, leaf, h AS subroot, h, f, p, dense_rank() OVER (ORDER BY g) - 1 AS i, (SELECT count(DISTINCT g) FROM d) AS n FROM l{depth})")
    for k in range(high):
        parts += level(f"t{k}", f"t{k + 1}", "doc_id, s.g, leaf, subroot")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM t{high}"


SQL = _sql()
