"""Top-k search against all scores, in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.llm import common, exact_topk

SCHEMA = "vec_id long, embedding array<double>, label int, rid string, at int, q_ids string"


def plain(rows, asks, k):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(own):
        if not asks(i):
            continue
        scored = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j is None, j or 0) for b, (j, w) in enumerate(own) if a != b]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(n, dims, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=dims) * scale).tolist(), 1, "x", 0, "y") for k in range(n)]


@pytest.mark.parametrize("scale", [0.1, 1e5, 1e9])
def test_equals_all_scores(spark, scale):
    rows = make(700, 12, 3, scale)
    rows += [(700 + k, rows[5][1], 1, "x", 0, "y") for k in range(200)]  # ties
    rows += [(100, rows[7][1], 1, "x", 0, "y"), (None, rows[8][1], 1, "x", 0, "y"), (None, rows[8][1], 1, "x", 0, "y")]  # a repeated id, null ids
    rows += [(1000, None, 1, "x", 0, "y"), (1100, [None] * 12, 1, "x", 0, "y"), (1200, [float("nan")] * 12, 1, "x", 0, "y"), (1300, [float("inf")] + [0.0] * 11, 1, "x", 0, "y")]
    rows += [(1400, [], 1, "x", 0, "y"), (1500, [0.5 * scale] * 3, 1, "x", 0, "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact_topk.search(df, F.col("vec_id") % 100 == 0, common.Scratch(spark, "t"))
    assert found(got) == plain(rows, lambda i: i is not None and i % 100 == 0, 10)


def test_beyond_64_bits(spark):
    rows = make(90, 6, 4, 1e13)
    got = exact_topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, common.Scratch(spark, "t"), k=3)
    assert found(got) == plain(rows, lambda i: i % 10 == 0, 3)


def test_few_rows_and_none(spark):
    rows = make(4, 5, 1)
    got = exact_topk.search(spark.createDataFrame(rows, SCHEMA), F.lit(True), common.Scratch(spark, "t"))
    assert found(got) == plain(rows, lambda i: True, 10) and got.count() == 12
    none = exact_topk.search(spark.createDataFrame([], SCHEMA), F.lit(True), common.Scratch(spark, "t"))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0
    assert exact_topk.search(spark.createDataFrame(rows, SCHEMA), F.lit(False), common.Scratch(spark, "t")).count() == 0


def test_blocks_are_passed_over_where_bounds_allow(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(32)[:20]
    rows = [(k, (centres[k % 20] + rng.normal(size=32) * 0.02).tolist(), 1, "x", 0, "y") for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = exact_topk.search(df, F.col("vec_id") % 100 == 0, common.Scratch(spark, "t"), report=True).agg(F.sum("blocks"), F.sum("scored")).first()
    assert seen[1] < 0.3 * seen[0]
    assert found(exact_topk.search(df, F.col("vec_id") % 100 == 0, common.Scratch(spark, "t"))) == plain(rows, lambda i: i % 100 == 0, 10)


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    m, q = rng.integers(-900, 900, (64, 16)), rng.integers(-900, 900, (30, 16))
    limit = exact_topk.bounds(q, m.max(0)[None], m.min(0)[None])[:, 0]
    assert (exact_topk.products(q, m).max(1) <= limit).all()
