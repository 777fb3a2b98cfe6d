"""Repeated substrings, counts and verdicts against plain statements of the rules."""

import random
import re

import numpy as np
import pytest

from millrace.llm import repeats


def plain_longest(s):
    out = [0] * len(s)
    for i in range(len(s)):
        for j in range(len(s)):
            n = 0
            while i != j and max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def plain_covered(words, k):
    at = {}
    for p in range(len(words) - k + 1):
        at.setdefault(tuple(words[p : p + k]), []).append(p)
    return sorted({q for ps in at.values() if len(ps) > 1 for p in ps for q in range(p, p + k)})


def plain(text, least):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    inside, again = plain_covered(words, least), len(plain_covered(words, 8))
    spans = []
    for q in inside:
        if spans and spans[-1][1] == q:
            spans[-1][1] = q + 1
        else:
            spans.append([q, q + 1])
    failed = len(words) < 20 or 100 * again > 30 * len(words)
    longest = max(plain_longest(words), default=0)
    kept = not failed and 100 * len(inside) <= 40 * len(words) and longest <= 50
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, again, len(inside), longest,
            [tuple(s) for s in spans], failed, kept)


def check(spark, rows, least=repeats.LEAST):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, Kept string, source int")
    made = repeats.judge(docs, least=least)
    assert [c for c in made.columns if c.lower() == "kept"] == ["kept"] and "source" in made.columns
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest_repeat,
            [tuple(s) for s in r.spans], r.base_failed, r.kept) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain(t, least)) for i, t in rows), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_longest_repeats(seed):
    rnd = random.Random(seed)
    for _ in range(100):
        s = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 40))]
        assert repeats.longest_repeats(np.array(s, np.uint64)).tolist() == plain_longest(s)


@pytest.mark.parametrize("least,seed", [(1, 1), (4, 2), (6, 3)])
def test_random_texts(spark, least, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "é#", "c*", "dd"]) if rnd.random() < 0.5 else f"u{rnd.randrange(999)}"
    check(spark, [(rnd.choice([None, *range(9)]), "".join(word() + rnd.choice([" ", "\n", "\t "]) for _ in range(rnd.randint(0, 60)))) for _ in range(60)], least)


def test_edges(spark):
    own = " ".join(f"w{i}" for i in range(60))
    check(spark, [(1, None), (2, ""), (3, " \n \n"), (4, own), (4, own), (5, own + " " + own[: own.index(" w51")] + " " + " ".join(f"x{i}" for i in range(200))),
                  (6, "same line\nsame line\n\n\nsame line "), (None, own), (7, "ok " * 40), (8, " ".join(f"v{i}" for i in range(19))), (9, "<|>" * 30)])


def test_long_text(spark):
    words = [f"w{i % 70_000}" for i in range(140_000)]
    made = repeats.judge(spark.createDataFrame([(1, " ".join(words)), (2, "a " * 100_000)], "doc_id long, text string")).collect()
    assert [(r.n_words, r.n_covered, r.longest_repeat, r.kept) for r in sorted(made)] == [(140_000, 140_000, 70_000, False), (100_000, 100_000, 99_999, False)]


def test_empty(spark):
    assert repeats.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
