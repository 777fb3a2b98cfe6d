"""Cheapest repair of conversations to ``(s?(ua)+)?``, by divide and conquer over four states.

Conversations are ordered by turn (nulls first), then role and text. Each row has at most one fault:
blank, a duplicate of an earlier row's role and text, or truncated. Blank rows and duplicates must go. Edits are
Keep (free), Rerole (2), Delete (3) and Insert of an empty user or assistant text (2); a truncated row that
stays costs 1 more. Of the cheapest edits those with the least string of initials are taken.

The grammar has four states: nothing yet, after s, after u, after a. A row, with the insertions before it, is
a matrix of the least costs between states, and rows are joined by adding along the best states. The solver
(Hirschberg's) runs costs forward to the middle row and backward to it, chooses the best crossing state, and
recurses into both halves, so that it needs four numbers a level and one byte a row. Edits of
so many rows are never the beginning of each other, so ties are settled by carrying the order of
the four states' strings along instead of the strings.

Matrices also join blocks: rows are dealt by ranges of (conversation, turn, role, text), so that a conversation
of any length spreads over tasks and no row set is gathered. One that lies inside a task is solved there. The
others leave blocks of at most ``BLOCK`` rows, or one row, each with its matrix; the states between blocks are found
from the matrices alone, and then each block is solved by itself. Only the digest of such a conversation runs through
one task, block by block.

Equal rows, turn included, are counted into one before they travel. Duplicates are found by a hash of
conversation, role and text: rows meet the first turn of those that occur twice, in a join that Spark divides
when one is very common.

A null role or text, and a null id or turn in the text that chooses the damage, count as one space. A null
conversation id is an id like any other. Roles other than system, user and assistant count by their first character; an empty role
has none and can't be kept. Very long texts are handled in place; they only make blocks short. Conversations
without rows keep a row of zeros, with an empty audit. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FAR = range(4), 1 << 60
#: the state after one more row of its role, where the grammar allows it
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an inserted or reroled row
NAMES = {USER: "user", ASSISTANT: "assistant"}
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # cost and insertions that end a conversation in each state
BLANK, DUPLICATE, CUT = 1, 2, 3
BLOCK, BLOCK_CHARS = 4096, 1 << 22

# A row's kind is one byte: 3 * (0 other, 1 s, 2 u, 3 a) + (0 sound, 1 truncated, 2 must go)
LETTERS = ["", "s", "u", "a"]


def _edges(kind: int) -> list:
    """By state before: {state after: (cost, edits)}, insertions before the row included."""
    letter, fault, out = LETTERS[kind // 3], kind % 3, []
    for state in STATES:
        best: dict = {}
        at, cost, edits = state, 0, ""
        for _ in range(3):  # two insertions reach every state
            found = [(at, cost + DELETE, edits + "D")]
            if fault != 2:
                extra = cost + (TRUNCATED if fault else 0)
                found.append((NEXT[at], extra + REROLE, edits + "R"))
                if letter and at in AFTER[letter]:
                    found.append((AFTER[letter][at], extra + KEEP, edits + "K"))
            for after, *way in found:
                best[after] = min(best.get(after, (FAR, "")), tuple(way))
            at, cost, edits = NEXT[at], cost + INSERT, edits + "I"
        out.append(best)
    return out


EDGES = [_edges(kind) for kind in range(12)]
#: for each kind and state before: (state after, cost, place of its edits among those from this state)
STEPS = [[[(q, c, sorted(w for _, w in row.values()).index(e)) for q, (c, e) in row.items()] for row in edges] for edges in EDGES]


def _ahead(costs: list, ranks: list, steps: list) -> tuple[list, list]:
    """Costs and order of the states' least strings after one more row or block."""
    best = [(FAR, 0, 0)] * 4
    for p in STATES:
        if costs[p] < FAR:
            for q, c, place in steps[p]:
                way = (costs[p] + c, ranks[p], place)
                if way < best[q]:
                    best[q] = way
    order = sorted(best[q][1:] for q in STATES)
    return [b[0] for b in best], [order.index(b[1:]) for b in best]


def _back(costs: list, steps: list) -> list:
    return [min((c + costs[q] for q, c, _ in row), default=FAR) for row in steps]


def _cross(costs: list, ranks: list, behind: list) -> int:
    """The crossing state of least cost, and of those the one with the least edits before it."""
    return min(STATES, key=lambda q: (costs[q] + behind[q], ranks[q]))


def _one(state: int) -> tuple[list, list]:
    return [0 if q == state else FAR for q in STATES], [0] * 4


def solve(kinds: bytes, start: int, end: int) -> list[str]:
    """For each row its insertions and edit, from one state to another."""
    if len(kinds) == 1:
        return [EDGES[kinds[0]][start][end][1]]
    middle = len(kinds) // 2
    costs, ranks = _one(start)
    for k in kinds[:middle]:
        costs, ranks = _ahead(costs, ranks, STEPS[k])
    behind = _one(end)[0]
    for k in reversed(kinds[middle:]):
        behind = _back(behind, STEPS[k])
    state = _cross(costs, ranks, behind)
    return solve(kinds[:middle], start, state) + solve(kinds[middle:], state, end)


def matrix(kinds: bytes) -> list:
    """Steps of a whole block, in the form of those of a row."""
    out = []
    for state in STATES:
        costs, ranks = _one(state)
        for k in kinds:
            costs, ranks = _ahead(costs, ranks, STEPS[k])
        out.append([(q, costs[q], ranks[q]) for q in STATES if costs[q] < FAR])
    return out


def boundaries(blocks: list) -> tuple[int, list[int]]:
    """Least cost of blocks in order, and the states before, between and behind them, by the same halving."""
    ends = [c for c, _ in END]

    def between(lo: int, hi: int, start: int, end: int) -> list[int]:
        if hi - lo == 1:
            return [end]
        middle = (lo + hi) // 2
        costs, ranks = _one(start)
        for b in blocks[lo:middle]:
            costs, ranks = _ahead(costs, ranks, b)
        behind = _one(end)[0]
        for b in reversed(blocks[middle:hi]):
            behind = _back(behind, b)
        state = _cross(costs, ranks, behind)
        return between(lo, middle, start, state) + between(middle, hi, state, end)

    costs, ranks = _one(START)
    for b in blocks:
        costs, ranks = _ahead(costs, ranks, b)
    last = _cross(costs, ranks, ends)
    return costs[last] + ends[last], [START, *(between(0, len(blocks), START, last) if blocks else [])]


@lru_cache(maxsize=1 << 14)
def _whole(kinds: bytes) -> tuple[int, int, tuple]:
    """Cost, last state and edits of a conversation in one piece."""
    cost, states = boundaries([matrix(kinds)] if kinds else [])
    return cost, states[-1], tuple(solve(kinds, START, states[-1])) if kinds else ()


def apply(edits: list[str], rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """The repaired ``role:text`` rows and the state behind them."""
    out = []
    for edit, (role, text) in zip(edits, rows):
        for e in edit:
            if e == "K":
                state = AFTER[role[0]][state]
                out.append(f"{role}:{text}")
            elif e != "D":
                state = NEXT[state]
                out.append(f"{NAMES[state]}:{text if e == 'R' else ''}")
    return out, state


def finish(state: int) -> list[str]:
    return [f"{r}:" for r in {"": [], "I": ["assistant"], "II": ["user", "assistant"]}[END[state][1]]]


STOPS = r"[.!?]"


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n: by a CRC of id and turn a row is dropped (n = 0), emptied, robbed of its stops,
    doubled (n = 2) or given to the user."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    luck = F.crc32(F.concat_ws(":", filled(conv_id), filled(turn))) % 20
    whole = filled(text)
    return rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(luck == 4, "user").otherwise(filled(role)).alias("role"),
        F.when(luck == 1, "").when(luck == 2, F.regexp_replace(whole, STOPS, "")).otherwise(whole).alias("text"),
        F.when(luck == 0, 0).when(luck == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, fault of the first copy, and kind of the first copy; equal rows are one."""
    key = F.md5(F.concat_ws(
        ":", F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"
    ))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    keyed = once.withColumn("_key", F.when(F.col("n") > 0, key))
    several = keyed.filter("n > 0").groupBy("_key").agg(
        F.max(F.col("turn").isNull()).alias("_without"), F.min("turn").alias("_first"), F.count("*").alias("_turns")
    ).filter("_turns > 1").drop("_turns")
    joined = keyed.join(several, "_key", "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("turn").isNotNull() & (F.col("_without") | (F.col("turn") > F.col("_first"))), DUPLICATE)
        .when(~last.rlike(STOPS), CUT).otherwise(0)
    )
    letter = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    state = F.when(F.col("fault") == 0, 0).when(F.col("fault") == CUT, 1).otherwise(2)
    judged = joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    return judged.withColumn("kind", 3 * letter + state)


PIECE = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
    *(T.StructField(c, T.LongType()) for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")),
    T.StructField("first_letter", T.StringType()), T.StructField("last_letter", T.StringType()),
    # of a whole conversation: cost, audit, sha256; of a block: matrix, kinds, roles, texts
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("sha256", T.StringType()),
    T.StructField("matrix", T.ArrayType(T.LongType())), T.StructField("kinds", T.BinaryType()),
    T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
])
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


class _Run:
    """Rows of one conversation in order, up to a block."""

    def __init__(self, conv_id, seq: int = 0):
        self.conv_id, self.seq, self.chars = conv_id, seq, 0
        self.kinds, self.roles, self.texts, self.turns, self.faults = bytearray(), [], [], [], []

    def add(self, turn, role, text, n, fault, kind):
        self.chars += n * len(text)
        for copy in range(n):
            if copy and fault != BLANK:
                fault, kind = DUPLICATE, kind // 3 * 3 + 2
            self.kinds.append(kind)
            self.roles.append(role)
            self.texts.append(text)
            self.turns.append(turn)
            self.faults.append(fault)

    @property
    def full(self) -> bool:
        return len(self.kinds) >= BLOCK or self.chars >= BLOCK_CHARS

    def row(self, part: int, whole: bool) -> dict:
        letters, known = [r[:1] for r in self.roles], [t for t in self.turns if t is not None]
        out = {
            "conv_id": self.conv_id, "part": part, "seq": self.seq, "rows": len(self.kinds), "turns": len(set(known)),
            "first_turn": min(known, default=None), "last_turn": max(known, default=None),
            **{c: self.faults.count(f) for c, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))},
            "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:])),
            "first_letter": letters[0] if letters else None, "last_letter": letters[-1] if letters else None,
        }
        kinds = bytes(self.kinds)
        if whole:
            cost, last, edits = _whole(kinds) if len(kinds) <= 64 else _whole.__wrapped__(kinds)
            made, _ = apply(edits, list(zip(self.roles, self.texts)), START)
            digest = hashlib.sha256("\n".join(made + finish(last)).encode()).hexdigest()
            return out | {"cost": cost, "audit": "".join(edits) + END[last][1], "sha256": digest}
        flat = []
        for row in matrix(kinds):
            ways = {q: (cost, place) for q, cost, place in row}
            flat += [x for q in STATES for x in ways.get(q, (FAR, 0))]
        return out | {"matrix": flat, "kinds": kinds, "roles": self.roles, "texts": self.texts}


def _steps(flat: list) -> list:
    """A block's steps out of the stored matrix."""
    return [[(q, flat[8 * p + 2 * q], flat[8 * p + 2 * q + 1]) for q in STATES if flat[8 * p + 2 * q] < FAR] for p in STATES]


_ARROW = pa.schema([
    (f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[f.dataType.simpleString()])
    for f in PIECE.fields
])


def pieces(faulty: DataFrame, parts: int) -> DataFrame:
    """Whole conversations, solved, and blocks of those that touch the edge of a task or are longer than a block."""
    order = ["conv_id", "turn", "role", "text"]

    def run(batches):
        from pyspark import TaskContext

        part, now, first, out = TaskContext.get().partitionId(), None, True, []

        def batch():
            made = pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out.clear()
            return made

        for b in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now is None:
                    now = _Run(conv_id)
                elif now.conv_id != conv_id:
                    out.append(now.row(part, whole=not first and not now.seq))
                    now, first = _Run(conv_id), False
                elif now.full:
                    out.append(now.row(part, False))
                    now = _Run(conv_id, now.seq + 1)
                now.add(*row)
                if len(out) >= 512 or now.full:
                    yield batch()
        if now is not None:
            out.append(now.row(part, False))  # may go on in the next task
        if out:
            yield batch()

    dealt = faulty.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select(*order, "n", "fault", "kind").mapInArrow(run, PIECE)


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "seq")


def _crossings(blocks: DataFrame) -> DataFrame:
    """conv_id, part, seq, before, behind (states), cost of the conversation. Reads matrices only."""
    def run(batches):
        def solved(conv_id, held):
            cost, states = boundaries([_steps(m) for _, _, m in held])
            return [(conv_id, p, s, a, b, cost) for (p, s, _), a, b in zip(held, states, states[1:])]

        now, held = None, []
        names = ["conv_id", "part", "seq", "before", "behind", "cost"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        out = []
        for b in batches:
            for conv_id, part, seq, flat in zip(*(c.to_pylist() for c in b.columns)):
                if held and now != conv_id:
                    out += solved(now, held)
                    held = []
                    if len(out) > 4096:
                        yield batch(out)
                        out = []
                now = conv_id
                held.append((part, seq, flat))
        if held:
            out += solved(now, held)
        if out:
            yield batch(out)

    narrow = _ordered(blocks.select("conv_id", "part", "seq", "matrix"))
    return narrow.mapInArrow(run, "conv_id long, part int, seq int, before int, behind int, cost long")


RESULT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    *(T.StructField(c, T.LongType()) for c in ("gaps", *COUNTS, "cost")),
    T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
])


def _joined(blocks: DataFrame) -> DataFrame:
    """Blocks solved between their states, and put together in order."""
    def solved(batches):
        names = [f.name for f in PIECE.fields if f.name not in ("matrix", "kinds", "roles", "texts", "cost", "sha256")]
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                edits = solve(r["kinds"], r["before"], r["behind"]) if r["kinds"] else []
                r["repaired"], _ = apply(edits, list(zip(r["roles"], r["texts"])), r["before"])
                r["audit"] = "".join(edits)
            schema = pa.schema([_ARROW.field(n) for n in names] + [("behind", pa.int32()), ("cost", pa.int64()), ("repaired", pa.list_(pa.string()))])
            for r in rows:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names}], schema=schema)

    def put_together(batches):
        now = None

        def result():
            return pa.RecordBatch.from_pylist([{
                "conv_id": now["conv_id"], **{c: now[c] for c in COUNTS}, "gaps": now["last_turn"] - now["first_turn"] + 1 - now["turns"] if now["turns"] else 0,
                "cost": now["cost"], "audit": "".join(now["audits"]) + END[now["behind"]][1], "repaired_sha256": digest(now, finish(now["behind"])).hexdigest(),
            }], schema=pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in RESULT.fields]))

        def digest(of, rows):
            for r in rows:
                of["hash"].update(("\n" * of["begun"] + r).encode())
                of["begun"] = 1
            return of["hash"]

        for b in batches:
            for r in b.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        yield result()
                    now = r | {"audits": [], "hash": hashlib.sha256(), "begun": 0}
                else:
                    for c in COUNTS:
                        now[c] += r[c]
                    if r["rows"]:
                        if now["last_letter"] is not None:
                            now["illegal"] += now["last_letter"] + r["first_letter"] not in LEGAL
                        now["last_letter"] = r["last_letter"]
                    if r["turns"]:
                        now["turns"] += r["turns"] - (now["last_turn"] == r["first_turn"] and now["turns"] > 0)
                        now["first_turn"] = r["first_turn"] if now["first_turn"] is None else now["first_turn"]
                        now["last_turn"] = r["last_turn"]
                    now["behind"] = r["behind"]
                now["audits"].append(r["audit"])
                digest(now, r["repaired"])
        if now is not None:
            yield result()

    # at most one block for BLOCK rows or so many characters, and two for each task: Spark decides how to join them
    states = _crossings(blocks).withColumnsRenamed({"conv_id": "_id", "part": "_part", "seq": "_seq"})
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))
    ready = blocks.drop("cost", "audit", "sha256", "matrix").join(states, same).drop("_id", "_part", "_seq")
    made = T.StructType([
        *(f for f in PIECE.fields if f.name not in ("matrix", "kinds", "roles", "texts", "cost", "sha256")),
        T.StructField("behind", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("repaired", T.ArrayType(T.StringType())),
    ])
    return _ordered(ready.mapInArrow(solved, made)).mapInArrow(put_together, RESULT)


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows as ``damaged`` gives
    them: conv_id, turn, role, text, n (copies; a conversation whose rows have none is empty)."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.col("n").cast("long"))
    made = stage(pieces(with_faults(rows), parts), "conversations")
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0)
    whole = made.filter("sha256 IS NOT NULL").select(
        "conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", F.col("sha256").alias("repaired_sha256")
    )
    return whole.unionByName(_joined(made.filter("sha256 IS NULL")))
