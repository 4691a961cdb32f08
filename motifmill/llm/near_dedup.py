"""MinHash near-dedup with min-max hashing.

A text's set holds its distinct ``shingle``-word shingles (A-Z lower-cased).  Under each
permutation both the least and the greatest value are kept, so ``permutations`` hash
evaluations give twice as many signature values, each equal in two texts with the
probability of their Jaccard similarity.  The values are banded; texts that share a band
are candidates, and every link is confirmed on the full sets (64-bit hashes of all shingles).
Groups are the connected components of the links.

With 144 permutations and 48 bands of 6 values, a pair at a similarity of 0.8 shares no
band with a probability of 5e-7, and the band of a pair at 0.3 is shared by 3 in 100.

How it scales.  Texts with equal sets are one class (found by a 128-bit hash of the set),
so groups of exact copies cost one row each.  A crowded bucket never gives all its pairs:
in round one each class is compared with one class only, of the leaders of its buckets the
one it shares most bands with; the components of these links follow.  Round two looks only at buckets that
still hold several components.  There the classes outside the bucket's largest component
ask: they are compared with that component and with each other.  All askers of a component
meet its members in one place, whatever bands they share, so that a text is sent there
once for each ``block[0]`` askers and not once for each band; where that would cost more than
going bucket by bucket (few askers, spread over many buckets), buckets are compared alone.
A block has about ``block`` rows and ``BLOCK_SHINGLES`` shingles of each side; its members are
held in memory, its askers pass one by one.
Within a block the sizes of all intersections are counted exactly, over an index of the
members' shingles; there is no filter by estimated similarity.  No link between components
is lost but to the bands, and a group of n near copies sends about n texts.  The price:
texts that share bands but are not linked are compared with all of the component, which
takes time (not texts sent) in proportion to their number times its size.

Defined cases: null and blank texts have an empty set and are linked with nothing; a
text of fewer words than a shingle has its whole sequence as the one shingle; very long
texts enter whole, in blocks with fewer others; ties between leaders go to the least class;
a component takes the least id of its rows, null if none has an id; rows of equal id and
text are the same document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import common
from motifmill.llm.components import components

PERMUTATIONS, BAND_VALUES, SHINGLE, PERCENT = 144, 6, 2, 80
#: Most askers and members in a block, and about the most shingles of either.
BLOCK, BLOCK_SHINGLES = (4096, 4096), 1 << 20
#: Most askers of one class in round one, where a block has one member.
ASKERS = 256
#: Comparisons that cost as much as sending a text.
PAIRS_A_TEXT = 1000


# --- sets and signatures ----------------------------------------------------


def set_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only


class MinMax:
    """Hashes of a text's shingles and their min-max signature (16 bits of each value)."""

    def __init__(self, permutations: int = PERMUTATIONS, shingle: int = SHINGLE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 62, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 62, permutations, dtype=np.uint64)
        self.words, self.shingle = common.WordHashes(), shingle

    def hashes(self, text: bytes | None) -> np.ndarray:
        words = set_words(text)
        h = common.mix(self.words(words))
        if not len(h):
            return h
        size = min(self.shingle, len(h))
        out = np.full(len(h) - size + 1, np.uint64(size))
        for k in range(size):
            out = common.mix(out * common.M1 + h[k : len(h) - size + 1 + k])
        return np.unique(out)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = high = None
        for k in range(0, len(hashes), 1024):
            v = (hashes[k : k + 1024, None] * self.a + self.b) >> np.uint64(32)
            least, most = v.min(axis=0), v.max(axis=0)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        return np.concatenate((low, high)).astype(np.uint16)


def band_keys(signatures: np.ndarray, values: int = BAND_VALUES) -> np.ndarray:
    """A key for each row and band; its last 6 bits are the band."""
    n, total = signatures.shape
    parts = signatures.reshape(n, total // values, values).astype(np.uint64)
    bands = np.arange(total // values, dtype=np.uint64)
    key = np.broadcast_to(bands, (n, len(bands))).copy()
    for k in range(values):
        key = common.mix(key * common.M1 + parts[:, :, k])
    return ((key & ~np.uint64(63)) | bands).view(np.int64)


# --- blocks -----------------------------------------------------------------


def intersections(asked: np.ndarray, shingles: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of one set with n sets, whose sorted shingles have ``owners``."""
    out = np.zeros(n, np.int64)
    step = max(1, (1 << 21) // max(1, n))  # shingles whose owners are listed at a time
    for k in range(0, len(asked), step):
        first = np.searchsorted(shingles, asked[k : k + step], "left")
        sizes = np.searchsorted(shingles, asked[k : k + step], "right") - first
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1]:
            out += np.bincount(owners[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)], minlength=n)
    return out


class Block:
    """The members (component, set) of one block, indexed by shingle; askers come one by one."""

    def __init__(self, members: list[tuple], percent: int):
        self.percent, self.parent = percent, {}
        self.sizes = np.array([len(s) for _, s in members])
        self.groups = np.array([c for c, _ in members])
        shingles = np.concatenate([s for _, s in members])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owners = shingles[order], np.repeat(np.arange(len(members)), self.sizes)[order]

    def root(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            x = y
        return x

    def ask(self, own: int, asked: np.ndarray) -> list[tuple[int, int]]:
        """Links of the asker's component to others of the block that are not yet linked in it."""
        found = []
        both = intersections(asked, self.shingles, self.owners, len(self.sizes))
        linked = (both > 0) & (100 * both >= self.percent * (self.sizes + len(asked) - both))
        for other in np.unique(self.groups[linked]).tolist():
            if (x := self.root(own)) != (y := self.root(other)):
                self.parent[x] = y
                found.append((own, other))
        return found


def compare_blocks(blocks: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (a, b) of components within blocks; a block is (space, p, q), a row asks or is a member."""
    rows = blocks.join(common.shuffled(texts.select("node", "t")), "node").select("space", "p", "q", "asks", "comp", "t")
    rows = rows.repartition("space", "p", "q").sortWithinPartitions("space", "p", "q", "asks")  # members first

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, now, members, block = MinMax(1, shingle), None, [], None
        for batch in batches:
            out = []
            for part in common.slices(batch, 5):
                for space, p, q, asks, comp, text in zip(*(c.to_pylist() for c in part.columns)):
                    if (space, p, q) != now:
                        now, members, block = (space, p, q), [], None
                    if not asks:
                        members.append((comp, maker.hashes(text)))
                    elif members:
                        block = block or Block(members, percent)
                        out += block.ask(comp, maker.hashes(text))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(compare, "a bigint, b bigint")


def _parts(rows: Column, shingles: Column, most: int) -> Column:
    """Parts that a side of so many rows and shingles is cut into."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(most)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("bigint")


def ask_blocks(members: DataFrame, sizes: DataFrame, scratch: common.Scratch, block: tuple[int, int]) -> DataFrame:
    """Blocks (space, p, q, asks, node, comp) in which all members of a bucket meet that are of different components.

    ``members`` has (key, node, comp), ``sizes`` the set size n of each node.
    """
    most_q, most_m = block
    inside = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("x"))
    mixed = inside.groupBy("key").agg(F.sum("x").alias("m"), F.max(F.struct("x", (-F.col("comp")).alias("c"))).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("key", (-F.col("main.c")).alias("main"), "m", (F.col("m") - F.col("main.x")).alias("a"))
    mixed = scratch.write(mixed, "mixed")
    spread = members.join(mixed.select("key", "main"), "key").select("key", "main", "node", "comp")
    spread = scratch.write(spread, "spread")

    # A component's askers meet it in one space, unless its buckets are cheaper one by one.
    cost = lambda a, m: m * F.ceil(a / most_q) + a * F.ceil(m / most_m) + a * m / PAIRS_A_TEXT
    apart = mixed.groupBy("main").agg(F.sum(cost(F.col("a"), F.col("m"))).alias("apart"))
    nodes = spread.groupBy("main", "node").agg(F.first("comp").alias("comp"))
    together = nodes.groupBy("main").agg(F.count_if(F.col("comp") != F.col("main")).alias("a"), F.count(F.lit(1)).alias("m"))
    chosen = together.join(apart, "main").select("main", (cost(F.col("a"), F.col("m")) <= F.col("apart")).alias("whole"))
    chosen = scratch.write(chosen, "chosen")
    whole = nodes.join(chosen.where("whole").select("main"), "main").select(F.col("main").alias("space"), F.lit(True).alias("whole"), "node", "comp", (F.col("comp") != F.col("main")).alias("outside"))
    single = spread.join(chosen.where("not whole").select("main"), "main").select(F.col("key").alias("space"), F.lit(False).alias("whole"), "node", "comp", (F.col("comp") != F.col("main")).alias("outside"))
    placed = scratch.write(whole.unionByName(single).join(sizes, "node"), "placed")

    outside = F.col("outside")
    counts = placed.groupBy("space", "whole").agg(F.count_if(outside).alias("a"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("an"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("mn"))
    counts = counts.select("space", "whole", _parts(F.col("a"), F.col("an"), most_q).alias("qs"), _parts(F.col("m"), F.col("mn"), most_m).alias("ms"))
    dealt = placed.join(scratch.write(counts, "counts"), ["space", "whole"])
    space = F.xxhash64("space", "whole").alias("space")  # components and buckets apart
    part = lambda seed, c: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    asked = dealt.where(outside).select(space, part(1, "qs").alias("p"), upto("ms").alias("q"), F.lit(True).alias("asks"), "node", "comp")
    all_ = dealt.select(space, upto("qs").alias("p"), part(2, "ms").alias("q"), F.lit(False).alias("asks"), "node", "comp")
    blocks = scratch.write(asked.unionByName(all_), "blocks")
    scratch.drop("mixed", "spread", "chosen", "placed", "counts")
    return blocks


# --- the operator -----------------------------------------------------------


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, band_values: int = BAND_VALUES, block: tuple[int, int] = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's key (k1, k2), id, set size, component id, whether it has the component's id, and whether its key leads.

    One key leads in a component, whatever the ids: the least by id (null last), k1, k2.
    Rows of equal id and text share it.  A row with an empty set leads alone.
    """
    if 2 * permutations % band_values or 2 * permutations // band_values > 64:
        raise ValueError("the signature is cut into at most 64 whole bands")
    spark = docs.sparkSession
    common.arrow_batches(spark)
    scratch = common.Scratch(spark, "near_dedup")
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    base = docs.select(i.alias("i"), F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(7)).alias("k2"), t.cast("binary").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        maker = MinMax(permutations, shingle)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                s1, s2, sizes, signatures = [], [], [], []
                for text in part.column(3).to_pylist():
                    h = maker.hashes(text)
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    s1.append((d >> 64) - (1 << 63))
                    s2.append((d & (1 << 64) - 1) - (1 << 63))
                    sizes.append(len(h))
                    if len(h):
                        signatures.append(maker.signature(h))
                keys = iter(band_keys(np.stack(signatures), band_values)) if signatures else iter(())
                bands = pa.array([next(keys) if n else None for n in sizes], pa.list_(pa.int64()))
                new = [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sizes, pa.int64()), bands]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(3)] + new, ["i", "k1", "k2", "s1", "s2", "n", "bands"])

    rows = scratch.write(base.mapInArrow(sketch, f"i {id_type}, k1 bigint, k2 bigint, s1 bigint, s2 bigint, n bigint, bands array<bigint>"), "rows")

    # Classes of equal sets; one row's text stands for each.
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("i").alias("least"), F.min(F.struct("k1", "k2")).alias("k"), F.min(F.struct(F.col("i").isNull().alias("no_id"), "i", "k1", "k2")).alias("lead"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = classes.select("s1", "s2", "least", "lead", "k.k1", "k.k2", "n", "bands").withColumn("node", F.monotonically_increasing_id())
    classes = scratch.write(classes, "classes")
    rows = scratch.write(rows.select("k1", "k2", "i", "s1", "s2", "n"), "marked")
    scratch.drop("rows")

    bands = classes.select("node", F.explode("bands").alias("key"))
    crowded = bands.groupBy("key").agg(F.count(F.lit(1)).alias("x")).where("x > 1")
    members = scratch.write(bands.join(scratch.write(crowded, "crowded"), "key").select("key", "node", "x"), "members")
    scratch.drop("crowded")

    # Texts of the classes that share a band with another.
    wanted = classes.select("k1", "k2", "node", "n").join(members.select("node").distinct(), "node")
    once = base.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    texts = scratch.write(once.join(common.shuffled(scratch.write(wanted, "wanted")), ["k1", "k2"]).select("node", "n", "t"), "texts")
    scratch.drop("wanted")

    # Round one: each class and the leader it shares most bands with.  A bucket is led by the
    # member that meets most others in all its buckets: of near copies, one of the least changed.
    met = members.groupBy("node").agg(F.sum("x").alias("met"))
    leaders = members.join(scratch.write(met, "met"), "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("c"))).alias("x"))
    leaders = scratch.write(leaders.select("key", (-F.col("x.c")).alias("c")), "leaders")
    votes = members.join(leaders, "key").where("node <> c").groupBy("node", "c").agg(F.count(F.lit(1)).alias("shared"))
    asked = votes.groupBy("node").agg(F.max(F.struct("shared", (-F.col("c")).alias("c"))).alias("x")).select("node", (-F.col("x.c")).alias("space"))
    asked = scratch.write(asked.join(texts.select("node", "n"), "node"), "asked")
    parts = asked.groupBy("space").agg(_parts(F.count(F.lit(1)), F.sum("n"), min(ASKERS, block[0])).alias("qs"))
    parts = scratch.write(parts, "parts")
    asks = asked.join(parts, "space").select("space", F.pmod(F.xxhash64("node"), F.col("qs")).alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(True).alias("asks"), "node", F.col("node").alias("comp"))
    meets = parts.select("space", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qs") - 1)).alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(False).alias("asks"), F.col("space").alias("node"), F.col("space").alias("comp"))
    links = scratch.write(compare_blocks(asks.unionByName(meets), texts, percent, shingle), "links1")
    one = scratch.write(components(links, scratch, "one"), "roots1")
    scratch.drop("met", "leaders", "asked", "parts", "links1")

    # Round two: buckets that hold several components.
    placed = members.select("key", "node").join(one, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    blocks = ask_blocks(scratch.write(placed, "members2"), texts.select("node", "n"), scratch, block)
    links = scratch.write(compare_blocks(blocks, texts, percent, shingle), "links2")
    scratch.drop("members", "members2", "texts", "blocks")
    two = scratch.write(components(links, scratch, "two").select(F.col("node").alias("root"), F.col("root").alias("top")), "roots2")

    # Component of each class, then of each row.
    placed = classes.select("node", "s1", "s2", "least", "lead").join(one, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.join(two, "root", "left").select("s1", "s2", "least", "lead", F.coalesce("top", "root").alias("top"))
    placed = scratch.write(placed, "tops")
    named = placed.groupBy("top").agg(F.min("least").alias("component_id"), F.min("lead").alias("head"))
    named = scratch.write(placed.join(scratch.write(named, "named"), "top").select("s1", "s2", "component_id", F.col("head.k1").alias("l1"), F.col("head.k2").alias("l2")), "components")
    scratch.drop("classes", "tops", "named", "links2", "roots1", "roots2")
    out = rows.join(named, ["s1", "s2"], "left")
    leads = F.coalesce((F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), F.lit(True))
    out = out.select("k1", "k2", F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "i").alias("component_id"), leads.alias("leads"))
    return out.withColumn("kept", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, also where its rows share an id or have none; the others go.

    Of rows with the leading id and text, the one with the least hash of all columns stays.
    Texts without words are linked with nothing and stay.
    """
    rows, names = common.hidden(docs)
    i, t = F.col(names["doc_id"]), F.col(names["text"])
    scratch = common.Scratch(spark, "near_dedup_stage")
    found = near_duplicates(rows, id_col=names["doc_id"], text_col=names["text"])
    marks = found.where("n_shingles > 0").groupBy("k1", "k2").agg(F.max("leads").alias("leads"), F.count(F.lit(1)).alias("n")).where("not leads or n > 1")
    marks = scratch.write(marks.select("k1", "k2", "leads"), "marks")
    keyed = rows.withColumns({"k1": F.xxhash64(i, t), "k2": F.xxhash64(t, i, F.lit(7))})
    alone = keyed.join(common.shuffled(marks.select("k1", "k2")), ["k1", "k2"], "left_anti").select(rows.columns)
    again = keyed.join(common.shuffled(marks.where("leads").select("k1", "k2")), ["k1", "k2"], "left_semi")
    again = again.groupBy("k1", "k2").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("row")).select("row.*")
    return common.shown(alone.unionByName(again), names)


# All pairs that share a shingle, with a recursive reach: the plain definition.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
