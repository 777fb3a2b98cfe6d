"""Edited texts, terms and neighbours against plain versions; likeness against the true similarity."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import fingerprints


def plain(rows):
    """(id, n_chars, edited) in order."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(known):
        t, following = t or "", known[(k + 1) % len(known)][1] or ""
        q = len(t) // 4
        out.append((i, len(t), t[: len(t) - q] + following[:q], following))
    return out + [(None, len(t or ""), (t or "")[: len(t or "") - len(t or "") // 4], "") for i, t in rows if i is None]


def jaccard(a, b):
    a, b = (Counter(w for w in re.split(r"[ \t-\r]+", x.lower()) if w) for x in (a, b))
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def check(rows, got):
    want = plain(rows)
    key = lambda x: sorted(x, key=repr)
    assert key((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == key((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _ in want)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fingerprints.fingerprints(docs, samples=64).collect()
    check(rows, got)
    text, by_text = dict(rows), {}
    for r in got:
        by_text.setdefault(text[r.doc_id], set()).add(r.fingerprint)
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * 64
    assert all(len(f) == 1 for f in by_text.values())
    truth = {i: (jaccard(text[i], e), jaccard(text[i], following)) for i, _, e, following in plain(rows)}
    edited = np.array([(r.near_edited, truth[r.doc_id][0]) for r in got])
    following = np.array([(r.near_next, truth[r.doc_id][1]) for r in got])
    for pairs in (edited, following):
        error = pairs[:, 0] - pairs[:, 1]
        assert abs(error.mean()) < 0.02 and np.sqrt((error**2).mean()) < 0.08


def test_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (3, None), (4, ""), (5, "  \n "), (7, "A\tb  c"), (None, "some text here"), (None, None), (9, "é" * 41), (10, "w " * 60_000), (12, "abc")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, place int")
    got = fingerprints.fingerprints(docs).collect()
    check(rows, got)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[7] and prints[3] == prints[4] == prints[5] and prints[1] != prints[9]
    near = {r.doc_id: r.near_next for r in got}
    assert near[3] == near[4] == 1.0 and near[5] == 0.0 and near[12] == 0.0


@pytest.mark.parametrize("rows", [[], [(5, "only one here")], [(None, None)]])
def test_few_rows(spark, rows):
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert all(r.near_next == 1.0 for r in got)


@pytest.mark.parametrize("bounds", [[], [5], list(range(0, 300, 7)), list(range(50))])
def test_ranges(spark, bounds):
    ids = spark.range(-5, 320)
    got = dict(ids.select("id", fingerprints.range_of(ids["id"], bounds)).collect())
    assert all(got[i] == sum(b <= i for b in bounds) for i in got)


def test_plan_has_one_text_shuffle_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(range") == 1 and "Python" not in plan and "Arrow" not in plan
