"""Repairs against all edits of short conversations and a plain search with strings; blocks against whole conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from millrace.llm import repair

STARTS = {0: "", 1: "s", 2: "u", 3: "a"}


def legal(letters):
    return bool(re.fullmatch(r"(s?(ua)+)?", letters))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, found):
    """Least (cost, audit, repaired) over all edits with at most two insertions in a place."""
    gaps = [(), ("user",), ("assistant",), *product(("user", "assistant"), repeat=2)]
    best = None
    for edits in product("KRSD", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found)):
            continue
        for holes in product(gaps, repeat=len(rows) + 1):
            made, audit, cost = [], "", 0
            for hole, e, (_, role, text), f in zip(holes, [*edits, ""], [*rows, (0, "", "")], [*found, ""]):
                made += [f"{r}:" for r in hole]
                audit += "I" * len(hole)
                cost += 2 * len(hole)
                if e:
                    audit += "R" if e == "S" else e
                    cost += {"K": 0, "R": 2, "S": 2, "D": 3}[e] + (e != "D" and f == "truncated")
                    made += [] if e == "D" else [f"{ {'K': role, 'R': 'user', 'S': 'assistant'}[e]}:{text}"]
            if legal("".join(m[:1].replace(":", "x") for m in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    return best


def search(rows, found):
    """The same by carrying the least string of each state along."""
    best = {0: (0, "", [])}
    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way
    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (c, a, m) in list(out.items()):
                put(out, 3 if s == 2 else 2, (c + 2, a + "I", [*m, "assistant:" if s == 2 else "user:"]))
        return out
    for (_, role, text), f in zip(rows, found):
        after = {}
        # before insertions are closed, so that a cheaper state's longer way is tried as well
        for s0, way in best.items():
            for s, (c, a, m) in inserted({s0: way}).items():
                put(after, s, (c + 3, a + "D", m))
                if f not in ("blank", "duplicate"):
                    more = c + (f == "truncated")
                    put(after, 3 if s == 2 else 2, (more + 2, a + "R", [*m, ("assistant:" if s == 2 else "user:") + text]))
                    to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(s)
                    if to:
                        put(after, to, (more, a + "K", [*m, f"{role}:{text}"]))
        best = after
    return min((inserted({s: w}).get(e) for s, w in best.items() for e in (0, 3) if e in inserted({s: w})), key=lambda w: w[:2])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def plain(rows, solve=search):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r[1:] for r in damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found, turns = faults(own), [r[0] for r in own if r[0] is not None]
        cost, audit, made = solve(own, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=None):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    made = repair.repair(repair.damaged(frame), parts)
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, made.collect()), key=repr)


def conversation(rnd, conv, n):
    text = lambda: rnd.choice(["Yes.", "No", "", " \t", "What?\n", "Fine! ", f"own {rnd.randrange(99)}."])
    return [(conv, rnd.choice([None, t, t, t, rnd.randrange(n + 1)]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Sys"]), rnd.choice([None, text(), text()])) for t in range(n)]


def test_search_finds_what_all_edits_give():
    rnd = random.Random(1)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3]:
        rows = [(t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "No", "", "So?"])) for t in range(n)]
        assert search(rows, faults(rows)) == every_edit(rows, faults(rows))


@pytest.mark.parametrize("seed", range(6))
def test_halving_finds_the_same_edits(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        rows = [(t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "No", "", f"own {t}", f"own {t}."])) for t in range(rnd.randint(1, 12))]
        found = faults(rows)
        kinds = bytes(3 * max(0, repair.LETTERS.index(r[1][0]) if r[1][0] in "sua" else 0) + {"": 0, "truncated": 1}.get(f, 2) for r, f in zip(rows, found))
        cost, audit, made = search(rows, found)
        cuts = sorted({0, len(kinds), *(rnd.randrange(len(kinds) + 1) for _ in range(3))})
        blocks = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        got, states = repair.boundaries([repair.matrix(b) for b in blocks])
        edits = [e for b, x, y in zip(blocks, states, states[1:]) for e in repair.solve(b, x, y)]
        out, last = repair.apply(edits, [r[1:] for r in rows], 0)
        assert (got, "".join(edits) + repair.END[last][1], out + repair.finish(last)) == (cost, audit, made)


@pytest.mark.parametrize("parts,block,seed", [(4, 4096, 1), (7, 3, 2), (1, 1, 3)])
def test_random_conversations(spark, monkeypatch, parts, block, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = [r for c in [None, *range(40)] for r in conversation(rnd, c, rnd.randint(1, 9))] + conversation(rnd, 77, 150)
    rows += rows[:20] + [(500, t, "user", "same.") for t in range(60)] + [(501, 5, "user", "same.")] * 30 + [(502, None, "system", "Only.")]
    dropped = next(i for i in range(600, 700) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "Gone."), (503, -2, "user", "x" * 200_000 + "."), (503, 10**12, "assistant", "y " * 50_000)]
    rnd.shuffle(rows)
    assert run(spark, rows, parts) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_given_conversations_and_bounded_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == plain(rows)
    hot = spark.createDataFrame([(1, t, "ua"[t % 2] + "x", f"t{t}.", 1) for t in range(20_000)], "conv_id long, turn long, role string, text string, n int")
    made = repair.pieces(repair.with_faults(hot), 8).groupBy("part").sum("rows").collect()
    assert len(made) == 8 and max(r[1] for r in made) < 6_000
    (only,) = repair.repair(hot, 8).collect()
    assert only.audit == "K" * 20_000 and only.cost == 0
