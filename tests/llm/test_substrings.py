"""Removed words against a plain statement of the rule; the automaton against plain search."""

import random
import re

import pytest

from millrace.llm import substrings


def plain(rows, window):
    cut = [(i, [] if t is None else [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]) for i, t in rows]
    least = {}
    for i, w in cut:
        for p in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=repr)


def check(spark, rows, window=13, **options):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_removed int, kept string")
    got = substrings.remove_repeats(docs, window=window, **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, window)


@pytest.mark.parametrize("window,letters,seed", [(13, 3, 1), (13, 2, 2), (4, 3, 3), (1, 5, 4), (6, 2, 5)])
def test_random_texts(spark, window, letters, seed):
    rnd = random.Random(seed)
    shared = [[rnd.choice("abcde"[:letters]) for _ in range(rnd.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [[rnd.choice(["x%d" % rnd.randrange(9000), "a", "b"]) for _ in range(rnd.randint(0, 12))] + rnd.choice(shared) for _ in range(rnd.randint(0, 3))]
        rows.append((rnd.randrange(50), rnd.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    check(spark, rows, window, shard_words=500)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i % 7919}" for i in range(30_000))
    check(spark, [
        (1, passage), (2, passage), (2, passage), (3, None), (4, ""), (5, " \n"), (None, passage), (0, None), (6, "before " + passage + " after"),
        (7, " ".join(passage.split()[:12])), (8, " ".join(passage.split()[20:33])), (9, long), (10, long + " é"), (11, passage.replace(" ", "\x0b")), (12, "a " * 100), (13, "a " * 90),
    ])


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton():
    rnd = random.Random(5)
    runs = [[rnd.randrange(3) for _ in range(rnd.randint(4, 30))] for _ in range(80)]
    a = substrings.Automaton()
    for i, r in enumerate(runs):
        a.add(r, 100 - i)
    a.settle()
    for r in runs + [[rnd.randrange(4) for _ in range(40)] for _ in range(30)]:
        want = []
        for p in range(len(r) - 3):
            docs = [100 - i for i, s in enumerate(runs) for q in range(len(s) - 3) if s[q : q + 4] == r[p : p + 4]]
            if docs:
                want.append((p + 3, min(docs)))
        assert list(a.statistics(r, 4)) == want
