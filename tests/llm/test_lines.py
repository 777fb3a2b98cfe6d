"""Deleted lines against a plain statement of the rule."""

import random

import pytest

from millrace.llm import lines


def plain(rows, size):
    """rows: (id, text). A run is deleted if it has an earlier position under a known id."""
    first = {}
    for i, t in rows:
        w = t.split("\n") if t is not None and i is not None else []
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        w, gone = t.split("\n"), set()
        for p in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[p : p + size])] < (i, p):
                gone.update(range(p, p + size))
        out.append((i, "\n".join(x for q, x in enumerate(w) if q not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def check(spark, rows, gram=2, window=2):
    docs = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, source string, N_lines int")
    made = lines.remove_lines(docs, gram=gram, window=window)
    assert made.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in made.collect()]
    assert sorted(got, key=repr) == plain(rows, gram + window - 1)


@pytest.mark.parametrize("gram,window,seed", [(2, 2, 1), (1, 1, 2), (3, 4, 3), (1, 5, 4)])
def test_random_texts(spark, gram, window, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(40)]), "\n".join(rnd.choice(["a", "b", "", f"u{rnd.randrange(2000)}"]) for _ in range(rnd.randint(0, 30)))) for _ in range(60)]
    unique = {}
    for i, t in rows:
        unique.setdefault(i, t)
    check(spark, [*unique.items(), (None, "a\nb\na"), (None, None)], gram, window)


def test_edges(spark):
    block = "one\ntwo\nthree"
    check(spark, [
        (1, block), (2, block), (2, block), (3, None), (4, ""), (5, "\n\n\n\n"), (6, "x\n" + block + "\ny"), (7, block + "\n" + block), (None, block),
        (8, block + "\r"), (9, "one\ntwo"), (10, "é\n" * 5000), (11, "long " * 30_000 + "\n" + block),
    ])


def test_empty(spark):
    assert lines.remove_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
