"""SimHash fingerprints and their near-duplicates by vantage-point trees.

A fingerprint bit is set if it is set in over half of the XXH64 values of a text's shingles. Equal
fingerprints are merged first. The distinct ones are dealt to shards by the upper levels of a
vantage-point tree, whose points and median distances come from a sample: a fingerprint
lives in one shard and, as a query, visits it and each shard that the triangle inequality cannot rule
out (its distance to the vantage point lies within the radius of the boundary). A shard goes on
building the tree over what lives in it and sends all its queries down together. Links found in a
shard leave it as a spanning forest, at most one link per fingerprint, so that no group of near
copies is emitted as all its pairs; components of the whole are found from these.

Only distinct fingerprints are compared: within three bits of one there are at most 43,745, which
bounds a dense group. The sharding is exact whatever the sample is; the sample keeps the shards small. It
is one fingerprint in 512 (or 8,192 in all), 16 for each shard, and reaches the driver: 16 MB for a
billion distinct fingerprints. Visitors of a shard are cut into blocks, so that a group stays bounded.

A null or wordless text has fingerprint zero and is linked like any other. Rows with a null id or a
repeated id are fingerprinted each for itself; a component of null ids alone has a null id. Empty
tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components, forest
from millrace.llm.frames import map_slices, text_bytes
from millrace.llm.words import NOT_SPACE, find, lower, mix
from millrace.session import stage

SEED = 42
RADIUS = 3


def fingerprint_slice(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """One unsigned fingerprint per text."""
    from xxhash import xxh64_intdigest

    words = find(lower(data), offsets, NOT_SPACE)
    n = np.diff(words.first)
    out = np.zeros(len(n), np.uint64)
    if not len(words.starts):
        return out
    # the words of the slice, each followed by one space
    size = words.ends - words.starts
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    inside = NOT_SPACE[words.data]
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[inside]
    text = joined.tobytes()
    # shingle i of a text runs from its word i over ``width`` words
    width = np.minimum(n, shingle)
    count = np.where(n > 0, n - width + 1, 0)
    filled = np.flatnonzero(count)
    edge = np.concatenate([[0], np.cumsum(count[filled])])
    start = np.repeat(words.first[filled] - edge[:-1], count[filled]) + np.arange(edge[-1])
    last = start + np.repeat(width[filled], count[filled]) - 1
    a, b = begin[start].tolist(), (begin[last] + size[last]).tolist()
    hashes = np.fromiter((xxh64_intdigest(text[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduceat(bits, edge[:-1], axis=0, dtype=np.int32)
    packed = np.packbits(2 * total > count[filled, None], axis=1, bitorder="little")
    out[filled] = packed.view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Documents with ``fp``, the fingerprint as a signed number."""
    def work(batch):
        return [pa.array(fingerprint_slice(*text_bytes(batch.column(text)), shingle).view(np.int64))]

    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "fp"]
    return map_slices(docs, text, work, keep, [T.StructField("fp", T.LongType())])


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    point: np.uint64
    median: int
    near: Node | int
    far: Node | int


def top_tree(sample: np.ndarray, depth: int) -> Node | int:
    """The upper levels; leaves are numbered from 0."""
    shards = iter(range(1 << 30))

    def grow(points, depth):
        if depth == 0 or len(points) < 8:
            return next(shards)
        tries = points[:: max(1, len(points) // 16)][:16]
        apart = [distance(points, v) for v in tries]
        best = int(np.argmax([d.astype(np.float64).std() for d in apart]))
        d, median = apart[best], int(np.median(apart[best]))
        if d.max() <= median:
            median = int(d.max()) - 1
        if d.min() > median:
            return next(shards)
        return Node(tries[best], median, grow(points[d <= median], depth - 1), grow(points[d > median], depth - 1))

    return grow(sample, depth)


def route(tree: Node | int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in points, shard, lives there): every shard that may hold a neighbour."""
    out = []

    def visit(node, at, home):
        if not len(at):
            return
        if isinstance(node, int):
            out.append((at, np.full(len(at), node, np.int32), home))
            return
        d = distance(points[at], node.point).astype(np.int64)
        for side, inside, reach in ((node.near, d <= node.median, d <= node.median + radius), (node.far, d > node.median, d > node.median - radius)):
            visit(side, at[reach], (home & inside)[reach])

    visit(tree, np.arange(len(points)), np.ones(len(points), bool))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))


def links_within(points: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 128, block: int = 1 << 21):
    """Links point < query within the radius, as a forest: the queries go down the tree together."""
    found, held = [], 0

    def compare(p, q):
        nonlocal found, held
        step = max(1, block // len(p))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            x, y = np.nonzero(distance(p[:, None], part[None, :]) <= radius)
            below = p[x] < part[y]
            if below.any():
                found.append((p[x[below]], part[y[below]]))
                held += int(below.sum())
        if held > 1 << 20:
            found = [forest(*(np.concatenate(s) for s in zip(*found)))]
            held = len(found[0][0])

    def visit(p, q):
        if not len(p) or not len(q):
            return
        if len(p) > leaf:
            point = p[len(p) // 2]
            d = distance(p, point)
            median = int(np.median(d))
            near = d <= median
            if not near.all():
                dq = distance(q, point).astype(np.int64)
                visit(p[near], q[dq <= median + radius])
                visit(p[~near], q[dq > median - radius])
                return
        compare(p, q)

    visit(points, queries)
    return forest(*(np.concatenate(s) for s in zip(*found))) if found else (np.empty(0, points.dtype),) * 2


def shard_tree(distinct: DataFrame, shard_size: int, per_shard: int = 16, least: int = 8192) -> tuple[Node | int, np.ndarray]:
    """The upper levels for shards of about ``shard_size`` fingerprints, and the sample they come from:
    ``per_shard`` fingerprints for each shard, which is one in ``shard_size / per_shard`` of all."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_size))))
    share = min(1.0, max(least, per_shard << depth) / max(1, n))
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = distinct.select("fp").filter(chosen).orderBy(F.xxhash64("fp"), "fp").collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    return top_tree(sample, depth), sample


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = 8192, visits: int = 32) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within the radius. A group
    holds the fingerprints of a shard and one block of its visitors, about ``visits`` times as many."""
    tree, sample = shard_tree(distinct, shard_size)
    some = sample[:2048]
    blocks = max(1, -(-len(route(tree, some, radius)[0]) // max(1, visits * len(some))))

    def deal(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                fp = batch.column("fp").slice(i, 1 << 14)
                values = fp.to_numpy(zero_copy_only=False).view(np.uint64)
                at, shard, home = route(tree, values, radius)
                block = (mix(values) % np.uint64(blocks)).astype(np.int32)[at]
                # as a point in every block of its shard, as a query in one
                point, lives, of = at[home], shard[home], np.arange(blocks, dtype=np.int32)
                at = np.concatenate([at, np.tile(point, blocks)])
                shard = np.concatenate([shard, np.tile(lives, blocks)])
                block = np.concatenate([block, np.repeat(of, len(point))])
                home = np.concatenate([np.zeros(len(home), bool), np.ones(len(point) * blocks, bool)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(block), fp.take(pa.array(at)), pa.array(home)], names=["shard", "block", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        a, b = links_within(fp[home], fp[~home], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, block int, fp long, home boolean")
    return dealt.groupBy("shard", "block").applyInArrow(search, "a long, b long")


def classes(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, shard_size: int = 8192) -> DataFrame:
    """fp, component_id: the least id among the rows of all fingerprints reachable from it.

    ``prints`` has an id column and ``fp``; it is read several times, so give a stored table."""
    distinct = stage(prints.groupBy("fp").agg(F.min(doc_id).alias("least_id")), "distinct")
    return linked_classes(distinct, near_links(distinct, radius, shard_size))


def linked_classes(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """fp, component_id, from a stored table of fp and least_id and links (a, b) between the fp."""
    roots = stage(components(links), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    return stage(rooted.join(least, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS,
                    shard_size: int = 8192) -> DataFrame:
    """doc_id, fp, component_id per row of the documents."""
    prints = stage(fingerprints(docs.select(doc_id, text), text, shingle, [doc_id]), "fingerprints")
    return prints.join(classes(prints, doc_id, radius, shard_size), "fp").select(doc_id, "fp", "component_id")
