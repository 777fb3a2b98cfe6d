"""The least capacity against all partitions, and the placing of rows."""

import random
import zlib
from itertools import combinations

import pytest

from millrace.llm import shards


def plain(sizes, n):
    best = sum(sizes)
    for cuts in combinations(range(len(sizes) + 1), n - 1):
        edges = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_least_capacity(seed):
    rnd = random.Random(seed)
    keys = sorted({f"{rnd.randrange(8)}{rnd.randrange(100):02}" for _ in range(rnd.randint(1, 11))})
    groups = [(k, rnd.choice([1, 2, 5, 40])) for k in keys]
    sums = {}
    for k, s in groups:
        sums[k[0]] = sums.get(k[0], 0) + s
    n = rnd.randint(1, 4)
    sizes = shards.Sizes(sorted(sums.items()), lambda r: [g for g in groups if g[0][0] == r])
    capacity = sizes.least_capacity(n, max(s for _, s in groups))
    assert capacity == plain([s for _, s in groups], n)
    first = sizes.first_keys(sizes.cuts(capacity, n))
    placed = [sum(k >= f for f in first) for k, _ in groups]
    assert max(sum(s for (_, s), p in zip(groups, placed) if p == q) for q in range(n)) == capacity


def check(rows, got, n):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    places = {}
    for r in got:
        places.setdefault(r.key, set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = sorted(got, key=lambda r: r.key)
    assert [r.shard for r in order] == sorted(r.shard for r in got)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = shards.assign(docs).collect()
    check(rows, got, 8)
    load = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    groups = {}
    for i, t in rows:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
    assert max(load) <= max(max(groups.values()), sum(load) / 8 + max(groups.values()))


def test_hot_group_and_edges(spark):
    rows = [(i, "copy " * 30) for i in range(400)] + [(i, f"text {i}") for i in range(400, 800)] + [(None, None), (None, None), (5, ""), (5, ""), (5, None), (900, "é" * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string")
    check(rows, shards.assign(docs).collect(), 8)


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, "same"), (2, "same")]])
def test_few_rows(spark, rows):
    check(rows, shards.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)
