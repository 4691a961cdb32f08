"""The manifest against a plain tree in Python."""

from hashlib import sha256

import pytest

from motifmill.llm import common, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int, k string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The top of some nodes and the siblings of each, one node at a time."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            first = i // 16 * 16
            proofs[j] += [x for k, x in enumerate(nodes[first : first + 16]) if first + k != i]
            at[j] = i // 16
        nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return (nodes[0] if nodes else None), proofs


def plain_leaf(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]])


def make(sizes):
    rows = []
    for source, n in sizes.items():
        for k in range(n):
            rows.append((k * 7 if k % 50 else None, source, None if k % 3 else "é", len(rows), [None, "", "Größe A", "abc Z" * (k % 40)][k % 4], "x", 1, "y"))
    return [*rows, rows[0], rows[5]]


@pytest.mark.parametrize("sizes", [{"a": 300, None: 17, "B": 257, "é": 6, "z": 4400}, {"a": 6}, {f"s{k:03d}": 6 for k in range(300)}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = make(sizes)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs, common.Scratch(spark, "t"), altered={"text": merkle.lowered(docs["text"])}, proofs=True).collect()
    groups = {}
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], plain_leaf(r), plain_leaf((*r[:4], low))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, proofs, order = [], [], []
    for g in names:
        ordered = sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))
        top, own = plain_tree([x[2] for x in ordered])
        tops.append(top)
        proofs.append(own)
        order.append(ordered)
    root, above = plain_tree(tops)
    want = [(x[1], x[2], tops[j], root, H(*own, *above[j]), x[2] == x[3]) for j in range(len(names)) for x, own in zip(order[j], proofs[j], strict=True)]
    key = lambda r: (r[1], str(r))
    assert sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got], key=key) == sorted(want, key=key)
    for r in got[:200]:
        assert H(*r["proof"]) == r["proof_sha256"] and merkle.fold(r["leaf"], r["proof"]) == root
        assert (r["folded_root"] == root) == r["verified"]


def test_empty_and_single(spark):
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA), common.Scratch(spark, "t"))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
    row = (2**60 + 1, None, None, None, "x" * 3_000_000, "", 0, "")
    got = merkle.manifest(spark.createDataFrame([row], SCHEMA), common.Scratch(spark, "t")).first()
    assert got["doc_id"] == 2**60 + 1 and got["leaf"] == got["root"] == got["folded_root"] == plain_leaf(row) and got["proof_sha256"] == H("")
