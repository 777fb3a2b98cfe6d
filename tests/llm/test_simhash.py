"""Fingerprints against a plain statement of the rule, links against all pairs."""

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from millrace.llm import simhash
from millrace.llm.components import components, forest

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    n = len(ids)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[top(i)] = top(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(n)]


def check(spark, rows, shard_size=8192):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs, shard_size=shard_size).collect()
    prints = [plain_print(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], prints, plain_components([r[0] for r in rows], prints)))
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == sorted(want, key=repr)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows, shard_size=16)


def test_edges(spark):
    long = "word%d " * 5000 % tuple(range(5000))
    check(spark, [
        (5, None, None), (3, "", None), (4, " \t\n", "z"), (9, "One two", None), (8, "one TWO", None), (8, "one two", None),
        (None, "one two", None), (None, "quite alone here now", None), (7, long, None), (6, long + "tail", None), (2, "É é x", None),
    ])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_tree_finds_every_near_pair(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)]
    for _ in range(3):
        near = near ^ np.where(rng.random(900) < 0.6, np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    points = np.unique(np.concatenate([base, near]))
    tree = simhash.top_tree(points[::3], depth)
    at, shard, home = simhash.route(tree, points, 3)
    assert np.array_equal(np.sort(at[home]), np.arange(len(points)))
    pairs = [simhash.links_within(points[at[(shard == s) & home]], points[at[shard == s]], 3, leaf=8) for s in np.unique(shard)]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    d = simhash.distance(points[:, None], points[None, :])
    want = forest(*(points[i] for i in np.nonzero(np.triu(d <= 3, 1))))
    assert dict(zip(*want)) == dict(zip(*forest(a, b)))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1300)] + [(7, 1000), (1001, 1000), (50, 50)]
    got = dict(components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, 7: 7, **{i: 7 for i in range(1000, 1300)}}


def test_deep_trees_keep_shards_small():
    rng = np.random.default_rng(1)
    points, depth, size = rng.integers(0, 2**63, 1 << 18, dtype=np.uint64), 13, 32
    tree = simhash.top_tree(points[: 16 << depth], depth)
    at, shard, home = simhash.route(tree, points, 0)
    assert len(at) == len(points) and home.all()
    held = np.bincount(shard)
    assert len(held) > 4000 and held.max() <= 6 * size


def test_visitors_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 400)
    near = base ^ (1 << rng.integers(0, 62, 400)) ^ (1 << rng.integers(0, 62, 400))
    points = np.unique(np.concatenate([base, near]))
    distinct = spark.createDataFrame([(int(p), 0) for p in points], "fp long, least_id long")
    got = simhash.near_links(distinct, shard_size=64, visits=2).collect()
    a, b = (np.array([r[c] for r in got]).view(np.uint64) for c in "ab")
    wide = points.view(np.uint64)
    want = forest(*(wide[i] for i in np.nonzero(np.triu(simhash.distance(wide[:, None], wide[None, :]) <= 3, 1))))
    assert dict(zip(*forest(a, b))) == dict(zip(*want)) and len(want[0]) >= 300
