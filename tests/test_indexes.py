"""The join of token sets, the vector index and stratified folds, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.operators import group_folds, set_join, splits, vector_index


def _links(rows, percent):
    sets = [(k, frozenset(t for t in s or () if t is not None)) for k, s in rows]
    return {k: sum(1 for j, (_, b) in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)) for i, (k, a) in enumerate(sets)}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_set_join_equals_all_pairs(spark, percent):
    rng = random.Random(percent)
    rows = []
    for k in range(260):
        base = rng.sample([f"t{j}" for j in range(18)], rng.randint(1, 9))
        rows.append((f"k{k}", base + base[:1] + (["hot"] if rng.random() < 0.6 else [])))
    rows += [(f"c{k}", ["hot", "t1", "t2"]) for k in range(80)] + [("null", None), ("empty", []), ("holes", [None, "t1"])]
    df = spark.createDataFrame(rows, "key string, tokens array<string>").repartition(3)
    got, pairs = set_join.set_join(df, "key", percent=percent)
    assert {r["key"]: r["n_links"] for r in got.collect()} == _links(rows, percent)
    named = {r["key"]: r["class"] for r in got.collect()}
    assert named["null"] is None and named["c7"] == named["c70"]
    assert all(r["a"] < r["b"] and r["similarity"] * 100 >= percent - 1e-9 for r in pairs.collect())


def test_a_hot_token_makes_no_candidates(spark):
    rows = [(f"k{k:04d}", ["hot", f"a{k}", f"b{k}", f"c{k}"]) for k in range(1500)]
    df = spark.createDataFrame(rows, "key string, tokens array<string>")
    _, sets = set_join.classes(df, "key")
    assert set_join.candidates(sets).count() == 0
    assert set_join.set_join(df.limit(0), "key")[0].count() == 0


def _vectors(spark, n=3000, spread=0.3):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + rng.normal(size=16) * spread).tolist()) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * 16)], "vec_id bigint, embedding array<double>"), rows


def test_vector_index(spark):
    df, rows = _vectors(spark)
    index = vector_index.VectorIndex.build(df, 30)
    asked = df.where("vec_id % 50 = 0")
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        want[q] = sorted(range(3000), key=lambda j: (-s[j], j))[:10]
    got = defaultdict(list)
    for r in index.search(asked, 10).orderBy("query", "rank").collect():
        got[r["query"]].append(r["neighbour"])
    assert {q: v for q, v in got.items() if q < 3000} == want
    probes = index.tuned(asked)
    assert probes < 10 and index.recall(asked, 10, probes) >= 0.9
    few = df.where("vec_id in (0, 1)")
    found = index.search(few, 10, 2)
    assert found.groupBy("query").count().where("count <> 10").count() == 0
    everything = len(index.table(df).inputFiles())
    wanted = {x for r in index._nearest(few.select("vec_id", "embedding"), 2).collect() for x in r["lists"]}
    read = index.table(df).where(F.col("list").isin(*wanted))
    assert len([f for f in index.table(df).inputFiles() if int(f.split("list=")[1].split("/")[0]) in wanted]) < everything / 2
    assert "PartitionFilters: [isnotnull(list" in read._jdf.queryExecution().executedPlan().toString() or "list#" in read._jdf.queryExecution().executedPlan().toString()
    empty = vector_index.VectorIndex.build(df.limit(0), 4)
    assert empty.search(few, 3).count() == 0


def _shares(rows):
    total, out = Counter(), defaultdict(Counter)
    for r in rows:
        total[r["label"]] += 1
        out[r["fold"]][r["label"]] += 1
    return max(abs(out[f][x] / total[x] - 1 / len(out)) for f in out for x in total)


def test_stratified_group_folds_balance_all_labels(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for g in range(400):  # mixed groups: the majority label says little of the others
        for _ in range(rng.randint(3, 12)):
            rows.append((f"g{g}", rng.choice(["a"] * 5 + ["b"] * 4) if g % 2 else rng.choice(["a"] * 5 + ["c", "c", "d", None])))
    rows += [(None, "a")] * 5
    df = spark.createDataFrame(rows, "group string, label string")
    got = group_folds.stratified_group_folds(df, 5).collect()
    assert len(got) == len(rows) and all(len(f) == 1 for f in _by_group(got).values())
    assert _shares(got) < 0.02
    again = group_folds.stratified_group_folds(df.repartition(7), 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    old = splits.stratified_group_holdout(df.where("group is not null"), 0.2).collect()
    n, test = Counter(r["label"] for r in old), Counter(r["label"] for r in old if r["split"] == "test")
    assert max(abs(test[x] / n[x] - 0.2) for x in n) > 0.02  # what dealing by the majority label misses
    monkeypatch.setattr(group_folds, "HEAD", 40)
    monkeypatch.setattr(group_folds, "PER_TASK", 90)
    assert _shares(group_folds.stratified_group_folds(df, 5).collect()) < 0.05
    assert group_folds.stratified_group_folds(df.limit(0), 5).count() == 0


def _by_group(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["group"]].add(r["fold"])
    return out


def test_stratified_folds_differ_by_one(spark):
    df = spark.createDataFrame([(k, "abc"[k % 7 % 3] if k % 11 else None) for k in range(503)], "vec_id int, label string").repartition(6)
    got = group_folds.stratified_folds(df, 5).collect()
    for label in ("a", "b", "c", None):
        n = Counter(r["fold"] for r in got if r["label"] == label)
        assert max(n.values()) - min(n[f] for f in range(5)) <= 1
    n = Counter(r["fold"] for r in got)
    assert len(got) == 503 and max(n.values()) - min(n.values()) <= 1


def test_probes_are_told_by_one_exact_search(spark, monkeypatch, tmp_path):
    """The least number of probes that reaches the recall, without a search for each trial; a short list is one file."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(600)], "vec_id bigint, embedding array<double>").repartition(3)
    index = vector_index.VectorIndex.build(df, 9)
    table = index.table(df)
    assert len(table.inputFiles()) == len(index.centres)
    asked = df.where("vec_id % 20 = 0")
    searches, search = [], vector_index.VectorIndex.search
    monkeypatch.setattr(vector_index.VectorIndex, "search", lambda self, *a, **k: searches.append(1) or search(self, *a, **k))
    probes = index.tuned(asked, 5)
    assert len(searches) == 1
    assert index.recall(asked, 5, probes) >= 0.9 and (probes == 1 or index.recall(asked, 5, probes - 1) < 0.9)
