"""Cheapest repair of conversations to the pattern ``(system? (user assistant)+)?``.

Every turn is kept, reroled or deleted, and empty turns may be inserted anywhere; of the cheapest
edits those with the least audit string (K, R, D, I in order) are taken.

Rank-compressed dynamic programming over four states (nothing yet, after a system, user or
assistant turn).  A layer is one turn: its macro edit is a run of inserts plus what happens to
the turn, written as I*D, I*K or I*R.  These codes are prefix-free, so audit strings of one layer
compare like their sequences of codes, and it is enough to keep, for every state, the least cost
and the rank of its audit string among those of its layer; the next layer compares (rank, code).
Parent pointers give the edits back.

Scale: turns are ordered by one range shuffle and cut into segments of bounded rows and bytes, so
a conversation may lie in many tasks.  A segment's effect is a table from state to state of
cost and rank, a layer like that of one turn; the layers of a conversation are
joined, which fixes the states between its segments, and each segment then traces its own edits.
Duplicates come from the first turn of each (conversation, role, text), counted with partial
aggregation.  Only the digest of a conversation's repaired text and its audit string run
through one task, as a stream of segments.

Defined cases: nulls count as one space (an id of null is a conversation of its own); turns that
agree in number are ordered by role, then text; an empty text or one of white space is blank; a
turn takes the first of its faults; roles are known by their first letter and kept as they are (an empty role never is);
texts of any length; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, lru_cache
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from motifmill.llm import common

#: Costs of the edits; a truncated turn that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States, and the role that may follow each by insertion or a new role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "system", "user", "assistant")
#: Inserts that make a state a whole conversation.
ENDING = (0, 2, 1, 0)
#: Macro edits in the order of their text; no code begins another.
CODES = sorted("I" * n + x for n in range(3) for x in "DKR")
#: Most turns and bytes of text of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
WHITE = " \t\n\x0b\f\r"

Layer = list[tuple[int, int, int, int]]


class Turn(NamedTuple):
    """What the edits of a turn depend on: its role's first letter (if it is one of s, u, a), whether it must be deleted, whether it is truncated."""

    initial: str
    gone: bool
    truncated: bool


def turn(role: str, gone: bool, truncated: bool) -> Turn:
    initial = role[:1]
    return Turn(initial if initial in ("s", "u", "a") and not gone else "", gone, truncated and not gone)


@cache
def turn_layer(t: Turn) -> Layer:
    """(state before, state after, cost, code) of the edits of a turn."""
    initial, gone, truncated = t
    out = []
    for before in range(4):
        for code, text in enumerate(CODES):
            state, cost = before, INSERT * (len(text) - 1)
            for _ in text[:-1]:
                state = NEXT[state]
            if text[-1] == "D":
                cost += DELETE
            elif gone:
                continue
            else:
                cost += TRUNCATED * truncated
                if text[-1] == "R":
                    state, cost = NEXT[state], cost + REROLE
                elif initial == "s" and state == START:
                    state = SYSTEM
                elif initial == NAMES[NEXT[state]][0]:
                    state = NEXT[state]
                else:
                    continue
            out.append((before, state, cost, code))
    return out


def _step(layer: Layer, costs: Sequence[int | None], ranks: Sequence[int]) -> tuple[list, list, list]:
    """Costs and ranks of the states after a layer, and (code, state before) of the best way to each."""
    best: list[tuple | None] = [None] * 4
    for before, after, cost, code in layer:
        if (so_far := costs[before]) is not None:
            way = (so_far + cost, ranks[before], code, before)
            if best[after] is None or way < best[after]:
                best[after] = way
    order = {x: k for k, x in enumerate(sorted({b[1:3] for b in best if b}))}
    return [b[0] if b else None for b in best], [order[b[1:3]] if b else 0 for b in best], [b[2:] if b else None for b in best]


@lru_cache(maxsize=1 << 16)
def _turn_step(t: Turn, costs: tuple, ranks: tuple) -> tuple[list, list, list]:
    return _step(turn_layer(t), costs, ranks)


class Forward:
    """The best way to each state, layer by layer: cost, rank of the audit string, and where it came from."""

    def __init__(self, start: int):
        self.cost: list[int | None] = [0 if s == start else None for s in range(4)]
        self.rank, self.trace = [0] * 4, []

    def add(self, layer: Layer, trace: bool = True) -> None:
        self._take(_step(layer, self.cost, self.rank), 0, trace)

    def add_turn(self, t: Turn, trace: bool = True) -> None:
        """The same for a turn: costs count from the least, so that the same few steps come again and again."""
        least = min(c for c in self.cost if c is not None)
        self._take(_turn_step(t, tuple(None if c is None else c - least for c in self.cost), tuple(self.rank)), least, trace)

    def _take(self, step: tuple[list, list, list], more: int, trace: bool) -> None:
        self.cost, self.rank = [None if c is None else c + more for c in step[0]], step[1]
        if trace:
            self.trace.append(step[2])

    def back(self, state: int) -> list[tuple[int, int, int]]:
        """(state before, code, state after) of every layer on the best way to a state."""
        out = []
        for step in reversed(self.trace):
            code, before = step[state]
            out.append((before, code, state))
            state = before
        return out[::-1]


def segment_layer(turns: list[Turn]) -> Layer:
    """The layers of many turns as one: for each pair of states the least cost and the rank of its audit string."""
    out = []
    for before in range(4):
        way = Forward(before)
        for t in turns:
            way.add_turn(t, trace=False)
        out += [(before, after, way.cost[after], way.rank[after]) for after in range(4) if way.cost[after] is not None]
    return out


def join_segments(segments: list[Layer]) -> tuple[int, list[tuple[int, int]], int]:
    """The least cost of a conversation, the states around each segment, and the inserts after the last."""
    way = Forward(START)
    for layer in segments:
        way.add(layer)
    cost, _, inserts, state = min((c + INSERT * ENDING[s], way.rank[s], ENDING[s], s) for s, c in enumerate(way.cost) if c is not None)
    return cost, [(before, after) for before, _, after in way.back(state)], inserts


def edited(turns: list[tuple[str, str, bool, bool]], before: int, after: int) -> tuple[str, list[str]]:
    """Audit string and repaired lines of turns (role, text, gone, truncated) between two states."""
    way = Forward(before)
    for role, _, gone, truncated in turns:
        way.add_turn(turn(role, gone, truncated))
    audit, lines = [], []
    for (role, text, *_), (state, code, _) in zip(turns, way.back(after), strict=True):
        audit.append(CODES[code])
        for _ in CODES[code][:-1]:
            state = NEXT[state]
            lines.append(f"{NAMES[state]}:")
        if CODES[code][-1] != "D":
            lines.append(f"{role if CODES[code][-1] == 'K' else NAMES[NEXT[state]]}:{text}")
    return "".join(audit), lines


def end_lines(inserts: int) -> list[str]:
    return ["user:", "assistant:"][2 - inserts :]


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults planted by the crc32 of ``conv_id:turn``: c (the id as text), turn, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select(text("conv_id").alias("c"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("c", "turn", "role", "text")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds h (digest of the text), last (its last character that is not white) and later (the role and text stand at a lesser turn)."""
    core = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumn("h", F.sha2(F.col("text"), 256)).withColumn("last", F.substring(core, -1, 1))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = rows.where("last <> ''")
    first = said.groupBy("c", "role", "h").agg(F.min(order).alias("first"))
    said = said.join(first, ["c", "role", "h"]).select(*rows.columns, (order > F.col("first")).alias("later"))
    return said.unionByName(rows.where("last = ''").withColumn("later", F.lit(False)))


_TEXT, _LONG = pa.string(), pa.int64()
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_TURN = pa.struct({"role": _TEXT, "text": _TEXT, "gone": pa.bool_(), "truncated": pa.bool_()})
_SEGMENT = _schema(c=_TEXT, at=_LONG, turns=pa.list_(_TURN), layer=pa.list_(pa.list_(_LONG)), **dict.fromkeys(_COUNTS, _LONG), head=_TEXT, tail=_TEXT, low=_LONG, high=_LONG, distinct=_LONG)
_CHOICE = _schema(c=_TEXT, at=_LONG, before=_LONG, after=_LONG, inserts=_LONG, cost=_LONG, gaps=_LONG, **dict.fromkeys(_COUNTS, _LONG))
_PIECE = _schema(c=_TEXT, at=_LONG, audit=_TEXT, lines=_LONG, piece=_TEXT, cost=_LONG, gaps=_LONG, **dict.fromkeys(_COUNTS, _LONG))
_OUT = _schema(c=_TEXT, cost=_LONG, gaps=_LONG, **dict.fromkeys(_COUNTS, _LONG), audit=_TEXT, repaired_sha256=_TEXT)


class _Segment:
    """The turns of a segment, in order, and its counts."""

    def __init__(self, c: str):
        self.c, self.turns, self.size = c, [], 0
        self.counts, self.head, self.tail = [0, 0, 0, 0], None, None
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, last: str, again: bool) -> None:
        blank, truncated = not last, last not in (".", "!", "?")
        fault = 0 if blank else 1 if again else 2 if truncated else 3
        if fault < 3:
            self.counts[fault] += 1
        initial = role[:1]
        self.counts[3] += bool(self.turns) and self.tail + initial not in ("su", "ua", "au")
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        self.turns.append((role, "" if fault < 2 else text, fault < 2, fault == 2))
        self.size += len(text)

    def row(self, at: int) -> dict:
        layer = segment_layer([turn(role, gone, truncated) for role, _, gone, truncated in self.turns])
        turns = [dict(zip(("role", "text", "gone", "truncated"), t, strict=True)) for t in self.turns]
        return {"c": self.c, "at": at, "turns": turns, "layer": [list(e) for e in layer]} | dict(zip(_COUNTS, self.counts, strict=True)) | {"head": self.head, "tail": self.tail, "low": self.low, "high": self.high, "distinct": self.distinct}


def _emit(rows: list[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), most):
        yield pa.RecordBatch.from_pylist(rows[k : k + most], schema=schema)


def segments(turns: DataFrame) -> DataFrame:
    """Turns (c, turn, role, text) as segments of consecutive turns of one conversation; ``at`` ascends along it."""
    common.arrow_batches(turns.sparkSession)
    keys = ["c", F.col("turn").asc_nulls_first(), "role"]
    rows = _faults(turns).repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    rows = rows.select("c", "turn", "role", "text", "h", "last", "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Segment | None = None
        done, before, at, size = [], None, 0, 0
        for batch in batches:
            for c, turn, role, text, h, last, later in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if own and (own.c != c or len(own.turns) >= SEGMENT_ROWS or own.size >= SEGMENT_BYTES):
                    done.append(own.row(at))
                    at, size, own = at + 1, size + own.size, None
                    if len(done) >= 256 or size >= SEGMENT_BYTES:
                        yield from _emit(done, _SEGMENT)
                        done, size = [], 0
                own = own or _Segment(c)
                own.add(turn, role, text, last, later or before == (c, turn, role, h))
                before = (c, turn, role, h)
        if own:
            done.append(own.row(at))
        yield from _emit(done, _SEGMENT)

    out = rows.mapInArrow(cut, from_arrow_schema(_SEGMENT))
    return out.withColumn("at", F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.col("at"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; of a large batch only one is made a Python object at a time."""
    for batch in batches:
        some = batch.num_rows if batch.nbytes < SEGMENT_BYTES else 1
        for k in range(0, batch.num_rows, some):
            yield from batch.slice(k, some).to_pylist()


def _choices(parts: DataFrame) -> DataFrame:
    """For every segment the states around it; the first of a conversation has its totals, the last the inserts after it."""

    def conversation(rows: list[dict]) -> list[dict]:
        cost, states, inserts = join_segments([[tuple(e) for e in r["layer"]] for r in rows])
        total = {k: sum(r[k] for r in rows) for k in (*_COUNTS, "distinct")}
        high = None
        for r in rows:
            total["distinct"] -= high is not None and r["low"] == high
            high = high if r["high"] is None else r["high"]
        total["illegal"] += sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        low = next((r["low"] for r in rows if r["low"] is not None), None)
        gaps = 0 if low is None else high - low + 1 - total.pop("distinct")
        out = [{"c": r["c"], "at": r["at"], "before": s[0], "after": s[1], "inserts": 0} for r, s in zip(rows, states, strict=True)]
        out[0] |= {"cost": cost, "gaps": gaps} | {k: total[k] for k in _COUNTS}
        out[-1]["inserts"] = inserts
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = [], []
        for r in _runs(batches):
            if own and own[0]["c"] != r["c"]:
                done += conversation(own)
                own = []
                if len(done) >= 256:
                    yield from _emit(done, _CHOICE)
                    done = []
            own.append(r)
        yield from _emit(done + (conversation(own) if own else []), _CHOICE)

    rows = parts.drop("turns").repartition("c").sortWithinPartitions("c", "at")
    return rows.mapInArrow(run, from_arrow_schema(_CHOICE))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, size = [], 0
    for r in _runs(batches):
        audit, lines = edited([(t["role"], t["text"], t["gone"], t["truncated"]) for t in r["turns"]], r["before"], r["after"])
        lines += end_lines(r["inserts"])
        out = {"audit": audit + "I" * r["inserts"], "lines": len(lines), "piece": "\n".join(lines)}
        done.append({k: r[k] for k in _PIECE.names if k in r} | out)
        size += len(out["piece"])
        if len(done) >= 256 or size >= SEGMENT_BYTES:
            yield from _emit(done, _PIECE)
            done, size = [], 0
    yield from _emit(done, _PIECE)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their pieces, in order: the text goes into the digest piece by piece."""
    own: dict | None = None
    sha, audit, begun = sha256(), [], False

    def row() -> dict:
        return {k: own[k] for k in _OUT.names if k in own} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    done = []
    for r in _runs(batches):
        if own is None or own["c"] != r["c"]:
            if own:
                done.append(row())
                if len(done) >= 256:
                    yield from _emit(done, _OUT)
                    done = []
            own, sha, audit, begun = {k: v for k, v in r.items() if k != "piece"}, sha256(), [], False
        audit.append(r["audit"])
        if r["lines"]:
            sha.update((("\n" if begun else "") + r["piece"]).encode())
            begun = True
    yield from _emit(done + ([row()] if own else []), _OUT)


def repair(turns: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation (c and the counts, cost, audit and digest), and its repaired text in pieces.

    ``turns`` has c (the conversation as text), turn, role and text.  The pieces (c, at, lines,
    piece) hold whole lines ``role:text`` and follow each other by ``at``, joined by line feeds.
    """
    parts = scratch.write(segments(turns), "segments")
    choices = _choices(parts)
    named = parts.select("c", "at", "turns").join(choices, ["c", "at"])
    pieces = scratch.write(named.mapInArrow(_pieces, from_arrow_schema(_PIECE)), "pieces")
    report = pieces.repartition("c").sortWithinPartitions("c", "at").mapInArrow(_whole, from_arrow_schema(_OUT))
    return report, pieces.select("c", "at", "lines", "piece")


def with_ids(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The report of every conv_id in ``rows``, those without turns left included."""
    ids = rows.select("conv_id").distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    empty = F.lit(sha256(b"").hexdigest())
    return ids.join(report, "c", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs ``conversations`` after planted damage."""
    rows = common.table(spark, sf_dir, "conversations")
    report, _ = repair(damaged(rows), common.Scratch(spark, "conversations"))
    return with_ids(rows, report)


def _sql() -> str:
    edges = []
    for initial in "sua-":
        for before, after, cost, code in turn_layer(Turn(initial, False, False)):
            text, state, lines = CODES[code], before, []
            for _ in text[:-1]:
                state = NEXT[state]
                lines.append(f"{NAMES[state]}:")
            edges.append(f"('{initial}', {before}, {after}, {cost}, '{text}', {lines}::VARCHAR[], '{NAMES[NEXT[state]]}')")
    crc = common.crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said, right(rtrim(text, {white}), 1) AS last FROM d),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN said > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id),
e(initial, a, z, cost, code, lines, new_role) AS (VALUES {', '.join(edges)}),
w AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM c
  UNION ALL SELECT * FROM (SELECT w.conv_id, f.pos, e.z, w.cost + e.cost + CASE WHEN fault = 't' AND right(code, 1) <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || code AS audit,
    list_concat(w.lines, e.lines, CASE right(code, 1) WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [new_role || ':' || text] END) AS lines
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.pos + 1 JOIN e ON e.a = w.state AND e.initial = CASE WHEN f.initial IN ('s', 'u', 'a') THEN f.initial ELSE '-' END
    WHERE fault NOT IN ('b', 'd') OR right(code, 1) = 'D')
    QUALIFY row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) = 1),
y AS (SELECT w.conv_id, cost + [0, 6, 3, 0][state + 1] AS cost, audit || ['', 'II', 'I', ''][state + 1] AS audit, list_concat(lines, [[], ['user:', 'assistant:'], ['assistant:'], []][state + 1]) AS lines FROM w JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND pos = n),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON i.conv_id IS NOT DISTINCT FROM z.conv_id"""


SQL = _sql()
