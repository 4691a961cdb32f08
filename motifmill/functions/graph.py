"""Graphs of templates from their tokens, and fingerprints of their paths.

A side is read by a fold over its tokens: atoms hang on the atom before them, parentheses come
back to where they opened, ring labels bind their two atoms, a dot starts anew.  An
atom's name is its token without the map number; a bond's name is the bond tokens before it (empty
for the default bond).  A ring bond takes the name at its closing label, or that at its opening
if there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifmill.functions.fold import indices, let
from motifmill.functions.structure import ATOM, RING

#: Most bonds of a path, and bits of a fingerprint.
PATH, BITS = 7, 4096

_BONDS = "array<struct<a:int,b:int,kind:string,ring:boolean>>"
_RINGS = "array<struct<label:string,atom:int,kind:string>>"


def atom_name(token: Column) -> Column:
    return F.regexp_replace(token, r":[0-9]+\]$", "]")


def graph(tokens: Column) -> Column:
    """struct(atoms, bonds) of the tokens of one side; ring labels that stay open bind nothing."""
    kind = lambda x: F.when(x.rlike(ATOM), "atom").when(x.rlike(RING), "ring").when(x.isin("(", ")", "."), x).otherwise("bond")
    read = F.transform(tokens, lambda x: F.struct(x.alias("x"), kind(x).alias("k")))
    none = F.lit(-1)

    def step(s: Column, t: Column) -> Column:
        return let(F.filter(s["rings"], lambda r: r["label"] == t["x"]), lambda same: moved(s, t, F.get(same, F.lit(0))))

    def moved(s: Column, t: Column, open_: Column) -> Column:
        atom, ring = t["k"] == "atom", t["k"] == "ring"
        new = F.size(s["atoms"])
        hung = F.struct(s["last"].alias("a"), new.alias("b"), s["kind"].alias("kind"), F.lit(False).alias("ring"))
        closed = F.struct(open_["atom"].alias("a"), s["last"].alias("b"), F.coalesce(F.nullif(s["kind"], F.lit("")), open_["kind"]).alias("kind"), F.lit(True).alias("ring"))
        opened = F.struct(t["x"].alias("label"), s["last"].alias("atom"), s["kind"].alias("kind"))
        known = s["last"] >= 0
        return F.struct(
            F.when(atom, F.array_append(s["atoms"], atom_name(t["x"]))).otherwise(s["atoms"]).alias("atoms"),
            F.when(atom & known, F.array_append(s["bonds"], hung)).when(ring & known & open_.isNotNull(), F.array_append(s["bonds"], closed)).otherwise(s["bonds"]).cast(_BONDS).alias("bonds"),
            F.when(atom, new).when(t["k"] == ".", none).when(t["k"] == ")", F.coalesce(F.try_element_at(s["stack"], none), none)).otherwise(s["last"]).alias("last"),
            F.when(t["k"] == "(", F.array_append(s["stack"], s["last"])).when(t["k"] == ")", F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"]).alias("stack"),
            F.when(ring & known & open_.isNull(), F.array_append(s["rings"], opened)).when(ring, F.filter(s["rings"], lambda r: r["label"] != t["x"])).otherwise(s["rings"]).cast(_RINGS).alias("rings"),
            F.when(t["k"] == "bond", F.concat(s["kind"], t["x"])).otherwise("").alias("kind"),
        )

    empty = lambda kind: F.array().cast(kind)
    start = F.struct(empty("array<string>").alias("atoms"), empty(_BONDS).alias("bonds"), none.alias("last"), empty("array<int>").alias("stack"), empty(_RINGS).alias("rings"), F.lit("").alias("kind"))
    return F.aggregate(read, start, step, lambda s: F.struct(s["atoms"].alias("atoms"), s["bonds"].alias("bonds")))


def degrees(g: Column) -> Column:
    """The bonds at each atom."""
    return F.transform(g["atoms"], lambda _, i: F.size(F.filter(g["bonds"], lambda b: (b["a"] == i) | (b["b"] == i))))


def path_names(g: Column, longest: int = PATH) -> Column:
    """The distinct names of all simple paths of up to ``longest`` bonds, read in the lesser direction."""

    def ends(i: Column) -> Column:
        own = F.filter(g["bonds"], lambda b: ((b["a"] == i) | (b["b"] == i)) & (b["a"] != b["b"]))
        return F.transform(own, lambda b: F.struct(F.when(b["a"] == i, b["b"]).otherwise(b["a"]).alias("to"), b["kind"].alias("kind")))

    def walk(x: Column) -> Column:
        near, names = x["near"], x["names"]
        single = lambda i: F.struct(F.array(i).alias("p"), F.get(names, i).alias("f"), F.get(names, i).alias("b"))
        first = F.transform(indices(F.size(names)), single)
        name = lambda p: F.least(p["f"], p["b"])

        def longer(p: Column) -> Column:
            steps = F.filter(F.get(near, F.element_at(p["p"], -1)), lambda e: ~F.array_contains(p["p"], e["to"]))
            return F.transform(steps, lambda e: F.struct(F.array_append(p["p"], e["to"]).alias("p"), F.concat(p["f"], e["kind"], F.get(names, e["to"])).alias("f"), F.concat(F.get(names, e["to"]), e["kind"], p["b"]).alias("b")))

        def step(s: Column, _: Column) -> Column:
            return let(F.flatten(F.transform(s["paths"], longer)), lambda new: F.struct(new.alias("paths"), F.array_distinct(F.concat(s["names"], F.transform(new, name))).alias("names")))

        start = F.struct(first.alias("paths"), F.array_distinct(F.transform(first, name)).alias("names"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(longest)), start, step, lambda s: s["names"]) if longest else start["names"]

    near = F.transform(indices(F.size(g["atoms"])), ends)
    return let(F.struct(near.alias("near"), g["atoms"].alias("names")), walk)


def bit_of(name: Column, bits: int = BITS) -> Column:
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint") % bits).cast("int")


def fold_bits(places: Column, bits: int = BITS) -> Column:
    """A set of bits as ``bits`` / 64 longs."""
    shifted = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p % 64)

    def word(k: Column) -> Column:
        own = F.filter(places, lambda p: F.floor(p / 64) == k)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda s, p: s.bitwiseOR(shifted(p)))

    return F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), word)


def set_bits(words: Column) -> Column:
    """The places of the bits that are set, ascending."""
    one = lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1)) == 1), lambda b: b + k * 64)
    return F.flatten(F.transform(words, one))


def shared(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two fingerprints; null if both are empty."""
    count = lambda words: F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))
    both, any_ = F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
    return count(both) / F.nullif(count(any_), F.lit(0))
