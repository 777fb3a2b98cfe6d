"""Cuts found by dividing cells: equal to those over all groups, whatever the sizes; few cells are divided."""

import hashlib
import random

import pytest

from millrace.llm import shards
from millrace.llm.shards import Cell, Cells


def cells_of(groups, digits, inside=None):
    found = {}
    for k, s in groups:
        if inside is None or k.startswith(inside):
            found.setdefault(k[:digits], []).append((k, s))
    return [Cell(p, sum(s for _, s in g), len(g)) for p, g in found.items()]


def plain_bounds(groups, n):
    """The least feasible capacity by trying greedy runs over all groups, and its cuts."""
    def run(capacity):
        first, load = [], 0
        for i, (k, s) in enumerate(groups):
            if load + s > capacity:
                first.append(k)
                load = 0
            load += s
        return first

    low, high = max(s for _, s in groups), sum(s for _, s in groups)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(run(middle)) < n else (middle + 1, high)
    return low, run(low)


def placed(groups, bounds):
    return [sum(k >= b for b in bounds) for k, _ in groups]


def search(groups, n, digits=1, deeper=1):
    asked = []

    def divide(wanted):
        asked.append(len(wanted))
        return [c for w in wanted for c in cells_of(groups, len(w.prefix) + deeper, w.prefix)]

    return shards.find_bounds(Cells(cells_of(groups, digits)), n, max(s for _, s in groups), divide), asked


@pytest.mark.parametrize("seed", range(60))
def test_same_cuts(seed):
    rnd = random.Random(seed)
    letters = "0123456789abcdef"[: rnd.choice([2, 4, 16])]
    keys = sorted({"".join(rnd.choice(letters) for _ in range(8)) for _ in range(rnd.randint(1, 300))})
    groups = [(k, rnd.choice([1, 2, 7, 30, 900])) for k in keys]
    n = rnd.randint(1, 9)
    capacity, want = plain_bounds(groups, n)
    got, _ = search(groups, n)
    loads = [sum(s for k, s in groups if sum(k >= f for f in got) == q) for q in range(n)]
    assert placed(groups, got) == placed(groups, want) and max(loads) == capacity


@pytest.mark.parametrize("hot", [None, 0.34, 0.9])
def test_few_cells_are_divided(hot):
    rnd = random.Random(7)
    groups = sorted((hashlib.sha256(str(i).encode()).hexdigest()[:10], rnd.randint(1, 5000)) for i in range(40_000))
    if hot:
        total = sum(s for _, s in groups)
        groups[12_345] = (groups[12_345][0], int(total * hot / (1 - hot)))
    got, asked = search(groups, 8, digits=2, deeper=1)
    assert placed(groups, got) == placed(groups, plain_bounds(groups, 8)[1])
    assert len(asked) <= 25 and max(asked) <= 2 * 2 * 8 * shards.NEAR
    assert sum(asked) < 500


def test_stored_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = shards.assign(docs, 5).select("key", "size", "shard").collect()
    sums = {}
    for r in rows:
        sums[r.key] = sums.get(r.key, 0) + r.size
    _, first = plain_bounds(sorted(sums.items()), 5)
    assert all(r.shard == sum(r.key >= f for f in first) for r in rows)


def test_keys_that_share_their_beginning(spark):
    keys = [("ab" * 20 + f"{i:04x}", 1 + i % 7) for i in range(2000)] + [(shards.NO_TEXT, 50)]
    groups = spark.createDataFrame(keys, "key string, size long")
    assert placed(keys, shards.shard_bounds(groups, 8)) == placed(keys, plain_bounds(sorted(keys), 8)[1])
