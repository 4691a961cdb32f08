"""Repair of conversations against every sequence of edits that is not too long."""

import itertools
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from motifmill.llm import common, conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, c string, at int, audit string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """Conversations after damage, by id."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        one = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def best_edits(turns, faults):
    """The cheapest audit and lines by trying all; at most two inserts before each turn and at the end."""
    found = []

    def go(k, cost, audit, initials, lines):
        if cost > limit[0]:
            return
        if k == len(turns):
            for n in range(3):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    if GOOD.match(initials + "".join(r[0] for r in roles)):
                        total = cost + 3 * n
                        limit[0] = min(limit[0], total)
                        found.append((total, audit + "I" * n, [*lines, *[f"{r}:" for r in roles]]))
            return
        role, text = turns[k][1:]
        for n in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                c, a, i, out = cost + 3 * n, audit + "I" * n, initials + "".join(r[0] for r in roles), [*lines, *[f"{r}:" for r in roles]]
                if not re.match(r"s?(ua)*u?\Z", i):
                    continue
                go(k + 1, c + 4, a + "D", i, out)
                if faults[k] not in ("blank", "duplicate"):
                    more = 3 * (faults[k] == "truncated")
                    for new, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                        if new and re.match(r"s?(ua)*u?\Z", i + new[:1]):
                            go(k + 1, c + price + more, a + letter, i + new[:1], [*out, f"{new}:{text}"])

    limit = [10**9]
    go(0, 0, "", "", [])
    return min(found)


def plain(rows):
    out, damaged = [], damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = damaged.get(conv, [])
        faults, said = [], set()
        for _, role, text in turns:
            core = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not core else "duplicate" if (role, text) in said else "truncated" if core[-1] not in ".!?" else "")
            said.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = best_edits(turns, faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report, _ = conversation_repair.repair(conversation_repair.damaged(df), common.Scratch(spark, "t"))
    return sorted(conversation_repair.with_ids(df, report).collect(), key=str)


def make(n, seed, most=6):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "How?", "  ", "", "Fine!\n", "Ünï. ", None, "A dot. in it"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            rows.append((conv if conv % 17 else None, None if rng.random() < 0.05 else turn * rng.choice((1, 1, 1, 2)), rng.choice(roles), rng.choice(texts), "x", 1, "y"))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_edits(spark, small, monkeypatch):
    if small:  # conversations of several segments
        monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", 2)
    rows = [r for r in make(220, 5) if r[0] is not None] + [(None, k, "user", "Yes.", "x", 1, "y") for k in range(4)]
    assert [tuple(r) for r in got(spark, rows)] == plain(rows)


def test_segments_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant", "system", "tool"]), f"{rng.choice(['Hm', 'Yes.'])} {rng.randint(0, 60)}{rng.choice(['.', '', '?'])}", "x", 1, "y") for k in range(3000)]
    whole = got(spark, rows)
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", 7)
    assert got(spark, rows) == whole and len(whole) == 1
    turns = damage(rows)[7]
    assert len(whole[0]["audit"].replace("I", "")) == len(turns)


def test_pieces_hold_the_repaired_text(spark):
    rows = [r for r in make(60, 3) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    report, pieces = conversation_repair.repair(conversation_repair.damaged(df), common.Scratch(spark, "t"))
    text = defaultdict(list)
    for r in pieces.where("lines > 0").orderBy("c", "at").collect():
        text[r["c"]].append(r["piece"])
    for r in report.collect():
        whole = "\n".join(text[r["c"]])
        assert sha256(whole.encode()).hexdigest() == r["repaired_sha256"]
        assert GOOD.match("".join(line[0] for line in whole.split("\n") if re.match("(user|assistant|system):", line)))


def test_empty_table_long_text_and_dropped_conversations(spark):
    empty = got(spark, [])
    assert empty == []
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(*gone, "user", "Hi.", "x", 1, "y"), (kept, 0, "user", "w " * 3_000_000 + ".", "x", 1, "y"), (kept, 1, "assistant", "Ok.", "x", 1, "y")]
    out = {r["conv_id"]: r for r in got(spark, rows)}
    assert tuple(out[gone[0]])[1:] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert out[kept]["audit"] == "KK" and out[kept]["cost"] == 0


def test_codes_are_prefix_free_and_ordered():
    codes = conversation_repair.CODES
    assert codes == sorted(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)
