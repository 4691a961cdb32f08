"""Graphs and fingerprints of templates against a walk in Python."""

import hashlib
import random

from pyspark.sql import functions as F

from motifmill.functions import graph, tokenizer
from motifmill.operators import graphs


def plain_graph(tokens):
    atoms, bonds, last, stack, rings, kind = [], [], -1, [], {}, ""
    for x in tokens:
        if x[0] == "[" or x in ("Cl", "Br") or x in "BCNOPSFIbcnopsAa*":
            name = x[: x.rindex(":")] + "]" if ":" in x and x[x.rindex(":") + 1 : -1].isdigit() else x
            if last >= 0:
                bonds.append((last, len(atoms), kind, False))
            last = len(atoms)
            atoms.append(name)
        elif x[-1].isdigit():
            if x in rings:
                at, first = rings.pop(x)
                bonds.append((at, last, kind or first, True))
            else:
                rings[x] = (last, kind)
        elif x == "(":
            stack.append(last)
        elif x == ")":
            last = stack.pop()
        elif x == ".":
            last = -1
        else:
            kind += x
            continue
        kind = ""
    return atoms, bonds


def plain_names(atoms, bonds, longest=7):
    near = {i: [] for i in range(len(atoms))}
    for a, b, kind, _ in bonds:
        if a != b:
            near[a].append((b, kind))
            near[b].append((a, kind))
    out = set()

    def walk(path, f, b):
        out.add(min(f, b))
        if len(path) <= longest:
            for to, kind in near[path[-1]]:
                if to not in path:
                    walk([*path, to], f + kind + atoms[to], atoms[to] + kind + b)

    for i, name in enumerate(atoms):
        walk([i], name, name)
    return out


def make(n, seed):
    rng = random.Random(seed)

    def side(depth=0):
        out = ""
        for _ in range(rng.randint(1, 5)):
            out += rng.choice(["C", "N", "[C;H1:3]", "[N,O:12]", "c", "Cl", "[$(C([OH]))]"])
            if rng.random() < 0.3 and depth < 2:
                out += f"({rng.choice(['', '=', '-'])}{side(depth + 1)})"
            out += rng.choice(["", "", "=", "#", "-", "."]) if rng.random() < 0.6 else ""
        return out.rstrip("=#-.") if depth == 0 else out.rstrip("=#-.")

    rings = ["C1CCCCC1", "C=1CC=1C%10CC%10", "C12CC1CC2", "C1CC1.N", "(C.N)O"]
    return [f"{side() if rng.random() < 0.6 else rng.choice(rings)}>>{side() if rng.random() < 0.6 else rng.choice(rings)}" for _ in range(n)]


def test_graphs_and_fingerprints_equal_a_plain_walk(spark):
    texts = sorted(set(make(150, 4)))
    df = spark.createDataFrame([(t, 1) for t in texts], "smarts string, n_bonds_of int")
    rows = {r["smarts"]: r for r in graphs.template_graph(df).collect()}
    prints = {r["smarts"]: r["fingerprint"] for r in graphs.path_fingerprint(df).collect()}
    assert set(rows) == set(prints) and len(rows) > 100
    for t, r in rows.items():
        sides = [plain_graph(tokenizer.scan(x)) for x in t.split(">>")]
        assert [(list(s["atoms"]), [tuple(b) for b in s["bonds"]]) for s in r["sides"]] == [(a, b) for a, b in sides], t
        assert r["n_bonds"] == sum(len(b) for _, b in sides) and r["n_rings"] == sum(x[3] for _, b in sides for x in b)
        assert r["degrees"] == [[sum((i == b[0]) or (i == b[1]) for b in bonds) for i in range(len(atoms))] for atoms, bonds in sides]
        names = {f"{k}:{n}" for k, (a, b) in enumerate(sides) for n in plain_names(a, b)}
        bits = {int(hashlib.md5(n.encode()).hexdigest()[:8], 16) % 4096 for n in names}
        words = prints[t]
        assert len(words) == 64 and {w * 64 + k for w, x in enumerate(words) for k in range(64) if (x % 2**64) >> k & 1} == bits


def test_fingerprints_of_equal_graphs_and_their_similarity(spark):
    df = spark.createDataFrame([("a", "C1CCCCC1>>CO"), ("b", "C%10CCCCC%10>>CO"), ("c", "C1CCCCC1>>CN"), ("d", "N>>S"), ("e", "[C:1]O>>O[C:2]"), ("f", "O[C:7]>>[C:9]O")], "k string, smarts string")
    w = {r["k"]: r["fingerprint"] for r in graphs.path_fingerprint(df).collect()}
    assert w["a"] == w["b"] and w["a"] != w["c"] and w["e"] == w["f"]
    pairs = spark.createDataFrame([(w["a"], w["c"]), (w["a"], w["b"]), (w["a"], w["d"]), ([0] * 64, [0] * 64)], "x array<bigint>, y array<bigint>")
    got = [r[0] for r in pairs.select(graph.shared(F.col("x"), F.col("y"))).collect()]
    assert 0 < got[0] < 1 and got[1] == 1 and got[2] < got[0] and got[3] is None
    bits = pairs.select(graph.set_bits(F.col("x")).alias("b")).first()["b"]
    assert spark.createDataFrame([(bits,)], "b array<int>").select(graph.fold_bits(F.col("b"))).first()[0] == w["a"]


def test_invalid_and_empty(spark):
    df = spark.createDataFrame([("C",), ("",), (None,), ("C>>",), ("C1>>C",)], "smarts string")
    assert graphs.template_graph(df).count() == 0 and graphs.path_fingerprint(df).count() == 0
    assert graphs.path_fingerprint(df.limit(0)).columns == ["smarts", "fingerprint"]
