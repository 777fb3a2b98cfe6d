"""Counts and Shapley values against a walk through all orders."""

import random
import re
from itertools import permutations

from millrace.llm import audit


def plain(docs, labels):
    first, quality, toxic = {}, {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            quality[i], toxic[i] = quality.get(i, 0) or q == 1, toxic.get(i, 0) or x == 1
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^ \t-\r]+", t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                  "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts.setdefault(s or "", []).append(({k for k, f in failed.items() if f}, bool(quality.get(i)), bool(toxic.get(i))))
    out = {}
    for part, rows in parts.items():
        total = {}
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, earlier = [r for r in left if f in r[0]], [r for r in rows if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] = total.get(f, 0) + len(gone)
                out[part, "".join(order), step] = (f, len(left), len(gone), len(earlier) - len(gone), sum(r[0] == {f} for r in rows),
                                                   sum(r[1] for r in gone), sum(r[2] for r in gone))
        for key in out:
            if key[0] == part:
                out[key] += (total[out[key][0]],)
    return out


def check(spark, docs, labels):
    frame = spark.createDataFrame([(i, t, s, "x") for i, t, s in docs], "doc_id long, text string, source string, part string")
    made = audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = made.collect()
    got = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) and got == plain(docs, labels)
    assert all(kind == "bigint" for name, kind in made.dtypes if name not in ("part", "filter_order", "step", "filter"))


def test_random_documents(spark):
    rnd = random.Random(5)
    def text():
        words = [rnd.choice(["a", "B", "c#", f"u{rnd.randrange(99)}", f"v{rnd.randrange(99)}"][rnd.randint(0, 4):]) for _ in range(rnd.choice([3, 49, 50, 70]))]
        return rnd.choice([" ", "\n", "\t"]).join(words)
    texts = [text() for _ in range(40)] + [None, "", "UPPER", "a\x0bb", " ".join(f"w{i}" for i in range(60))]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice([None, "", "s1", "s2"])) for _ in range(150)]
    labels = [(rnd.choice([None, *range(80)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(70)]
    check(spark, docs, labels)


def test_one_text_everywhere_and_long_text(spark):
    same = [(i, "the same text", "s") for i in range(300)]
    check(spark, [*same, (300, "long " * 50_000, "t"), (7, "the same text", "t")], [(i, 1, i % 2) for i in range(300)])


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).collect() == []


def test_copies_join_can_be_divided(spark):
    """Rows of a common text meet its first id in a join, not in a window or a list."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = audit.with_failures(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Window" not in plan and "collect" not in plan
