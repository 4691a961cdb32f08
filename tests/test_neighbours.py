"""The neighbour graph against exact neighbours, and its weights."""

import math

import numpy as np

from motifmill.operators import neighbours


def test_graph_and_weights(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    m = np.concatenate([centres[k % 12] + rng.normal(size=24) * 0.6 for k in range(900)]).reshape(900, 24)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(2000, None)], "vec_id bigint, embedding array<double>").repartition(4)
    k = 10
    graph = neighbours.neighbours(df, k).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    exact = {(a, int(b)) for a in range(900) for b in np.argsort(-s[a])[:k]}
    assert len(graph) == 900 * k and len({(r["a"], r["b"]) for r in graph} & exact) >= 0.95 * len(exact)
    assert all(abs(r["similarity"] - s[r["a"], r["b"]]) < 1e-9 for r in graph[:500])
    edges = spark.createDataFrame(graph)
    weights = {(r["a"], r["b"]): r["weight"] for r in neighbours.fuzzy_weights(edges, k).collect()}
    assert all(abs(weights[b, a] - w) < 1e-12 and 0 < w <= 1 + 1e-12 for (a, b), w in weights.items())
    near = {}
    for r in graph:
        near.setdefault(r["a"], []).append((1 - r["similarity"], r["b"]))
    own = {}
    for a, pairs in near.items():
        least, low, high = min(pairs)[0], 1e-6, 100.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if sum(math.exp(-(d - least) / middle) for d, _ in pairs) > math.log2(k) else (middle, high)
        own.update({(a, b): math.exp(-(d - least) / low) for d, b in pairs})
    for (a, b), w in list(weights.items())[:2000]:
        x, y = own.get((a, b), 0.0), own.get((b, a), 0.0)
        assert abs(w - (x + y - x * y)) < 1e-5


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert neighbours.neighbours(df, 5).count() == 6
    assert neighbours.neighbours(df.limit(0), 5).count() == 0


def test_rows_meet_once(spark, monkeypatch):
    """Vectors are sent to the nodes they are near, not with every candidate; a hub's rows are dealt to several tasks without a change."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 16)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(2)
    sent, meet = [], neighbours._meet

    def counted(members, *rest):
        sent.append(members.groupBy("m", "x").count().agg({"count": "max", "m": "count"}).first())
        return meet(members, *rest)

    monkeypatch.setattr(neighbours, "_meet", counted)
    graph = {(r["a"], r["b"]): r["similarity"] for r in neighbours.neighbours(df, 6, rounds=3).collect()}
    assert all(r["max(count)"] == 1 and r["count(m)"] <= 400 * 4 * 6 for r in sent)
    monkeypatch.setattr(neighbours, "TAKERS", 4)
    dealt = {(r["a"], r["b"]): r["similarity"] for r in neighbours.neighbours(df, 6, rounds=3).collect()}
    assert graph.keys() == dealt.keys() and all(abs(graph[e] - s) < 1e-9 for e, s in dealt.items())
