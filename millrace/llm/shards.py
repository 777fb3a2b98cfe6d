"""Sharding as a minimax contiguous partition of atomic groups.

Rows with equal texts form a group, which stays whole. Groups are ordered by the SHA-256 of their text
and cut into consecutive shards so that the largest shard is as small as it can be. Whether a
capacity is feasible is checked greedily: fill each shard with as many groups as fit. The least
feasible capacity is found by binary search; the cuts of its greedy run are taken.

The driver never holds all group sizes. It holds cells: at first the sums of 65,536 ranges of the order.
Taking cells as atomic gives a greedy run that reaches too little, taking those of several groups as
divisible to any amount one that reaches too far; the least capacity lies between the least ones that are
feasible either way. The cells in which a cut of these runs falls are divided into 256 each, all of a
round in one job, until both runs have the same cuts. The groups are stored in ranges of their keys, so
that such a job reads the files of its cells only. Group sizes are combined before the shuffle, so a
group with very many copies is one row by then. However many groups there are, a round brings at most
``2 * 2 * shards * NEAR`` cells of 256.

A row's shard then follows from its key and the cuts. Its slot counts the rows of the shard: by cells
(a hash of the id), then by id inside a cell; only the sizes of the cells, a fixed number, meet.

A null text has no bytes and all null texts are one group, as are all empty ones. Null and repeated ids
are rows like others. Empty tables give no rows. Only the id and the text are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import in_buckets, shuffle
from millrace.session import stage

DIGITS = 4
DEEPER = 2  # digits by which a cell is divided
NEAR = 8
RANGES = 16**DIGITS
CELLS = 4096
NO_TEXT = "-"  # sorts before all hex keys


def group_key(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(NO_TEXT))


def _range(key: str) -> Column:
    return F.substring(key, 1, DIGITS)


class Sizes:
    """Running sums over ordered groups: of ranges at once, of the groups inside a range on demand."""

    def __init__(self, sums: list[tuple[str, int]], fetch: Callable[[str], list[tuple[str, int]]]):
        self.names = [name for name, _ in sums]
        self.ends = []
        for _, size in sums:
            self.ends.append(size + (self.ends[-1] if self.ends else 0))
        self.total = self.ends[-1] if self.ends else 0
        self.fetch, self.inside = fetch, {}

    def within(self, r: int) -> tuple[list[str], list[int]]:
        if r not in self.inside:
            keys, ends, at = [], [], self.ends[r - 1] if r else 0
            for key, size in self.fetch(self.names[r]):
                at += size
                keys.append(key)
                ends.append(at)
            self.inside[r] = keys, ends
        return self.inside[r]

    def reach(self, limit: int, whole: bool) -> int:
        """The largest running sum up to the limit, at the end of a range or of any group."""
        r = bisect_right(self.ends, limit)
        below = self.ends[r - 1] if r else 0
        if whole or r == len(self.ends):
            return below
        ends = self.within(r)[1]
        i = bisect_right(ends, limit)
        return ends[i - 1] if i else below

    def cuts(self, capacity: int, shards: int, whole: bool = False) -> list[int] | None:
        """Running sums at which the greedy shards end; None if the groups do not fit."""
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity, whole)
            out.append(at)
        return out if at == self.total else None

    def least_capacity(self, shards: int, largest: int) -> int:
        def search(low, high, whole):
            while low < high:
                middle = (low + high) // 2
                if self.cuts(middle, shards, whole):
                    high = middle
                else:
                    low = middle + 1
            return low

        low = max(-(-self.total // shards), largest)
        high = search(low, max(low, self.total), True)
        return search(low, high, False)

    def first_keys(self, cuts: list[int]) -> list[str]:
        """The key of the first group behind each cut but the last; shards may be empty at the end."""
        out = []
        for at in cuts[:-1]:
            if at == self.total:
                break
            r = bisect_right(self.ends, at)
            keys, ends = self.within(r)
            out.append(keys[bisect_right(ends, at)])
        return out


@dataclass(frozen=True)
class Cell:
    """Consecutive groups: the beginning that only their keys have, bytes and number."""

    prefix: str
    size: int
    groups: int


class Cells(Sizes):
    """Running sums over cells, each taken as one group, and how far a run could get inside them."""

    def __init__(self, cells: list[Cell]):
        self.cells = sorted(cells, key=lambda c: c.prefix)
        super().__init__([(c.prefix, c.size) for c in self.cells], lambda prefix: [])

    def within(self, r: int) -> tuple[list[str], list[int]]:
        return [self.names[r]], [self.ends[r]]

    def at(self, limit: int) -> tuple[int, bool]:
        """The cell in which a limit falls, and whether its groups would have to be known."""
        r = bisect_right(self.ends, limit)
        below = self.ends[r - 1] if r else 0
        return r, r < len(self.ends) and self.cells[r].groups > 1 and limit > below

    def furthest_cuts(self, capacity: int, shards: int) -> list[int]:
        """Bounds above the running sums at which the greedy shards end."""
        at, out = 0, []
        for _ in range(shards):
            limit = at + capacity
            r, unknown = self.at(limit)
            at = limit if unknown else self.reach(limit, True)
            out.append(at)
        return out

    def nearest_cuts(self, capacity: int, shards: int) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity, True)
            out.append(at)
        return out

    def bounds(self, shards: int, largest: int) -> tuple[int, int]:
        """Two capacities between which the least feasible one lies."""
        high = self.least_capacity(shards, largest)
        low, top = max(-(-self.total // shards), largest), high
        while low < top:
            middle = (low + top) // 2
            if self.furthest_cuts(middle, shards)[-1] == self.total:
                top = middle
            else:
                low = middle + 1
        return low, high

    def to_divide(self, low: int, high: int, shards: int) -> list[Cell]:
        """Cells that keep the cuts unknown; none if the greedy cuts of ``low`` = ``high`` are known."""
        wanted = set()
        for capacity in {low, (low + high) // 2}:
            near, far = self.nearest_cuts(capacity, shards), self.furthest_cuts(capacity, shards)
            if near == far:
                continue
            for a, b in zip([0, *near[:-1]], [0, *far[:-1]]):
                (r, unknown), (s, also) = self.at(a + capacity), self.at(b + capacity)
                wanted.update([r] * unknown, [s] * also)
                if s - r < NEAR:
                    wanted.update(i for i in range(r + 1, min(s, len(self.cells))) if self.cells[i].groups > 1)
        return [self.cells[i] for i in sorted(wanted)]

    def divided(self, gone: list[Cell], found: list[Cell]) -> Cells:
        dropped = set(gone)
        return Cells([c for c in self.cells if c not in dropped] + found)


def find_bounds(cells: Cells, shards: int, largest: int, divide: Callable[[list[Cell]], list[Cell]]) -> list[str]:
    """Where shards 1, 2 ... begin, as prefixes; ``divide`` gives the cells inside some."""
    while True:
        low, high = cells.bounds(shards, largest)
        wanted = cells.to_divide(low, high, shards)
        if not wanted:
            return cells.first_keys(cells.nearest_cuts(high, shards))
        cells = cells.divided(wanted, divide(wanted))


def _cells(groups: DataFrame, prefix: Column) -> list:
    return groups.groupBy(prefix.alias("prefix")).agg(
        F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest")).collect()


def shard_bounds(groups: DataFrame, shards: int) -> list[str]:
    """For stored groups (key, size), what the keys of shards 1, 2 ... and of later ones are not less than."""
    def divide(wanted: list[Cell]) -> list[Cell]:
        by_length: dict[int, list[str]] = {}
        for cell in wanted:
            by_length.setdefault(len(cell.prefix), []).append(cell.prefix)
        deeper = [F.when(F.substring("key", 1, n).isin(names), F.substring("key", 1, n + DEEPER)) for n, names in by_length.items()]
        inside = groups.filter(in_buckets("key", [cell.prefix for cell in wanted]))
        return [Cell(r["prefix"], r["size"], r["groups"]) for r in _cells(inside, F.coalesce(*deeper))]

    rows = _cells(groups, _range("key"))
    if not rows:
        return []
    cells = Cells([Cell(r["prefix"], r["size"], r["groups"]) for r in rows])
    return find_bounds(cells, shards, max(r["largest"] for r in rows), divide)


def assign(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (bytes and one), text_crc32, key, shard and slot of every row."""
    if shards < 1:
        raise ValueError("there must be a shard")
    rows = stage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), group_key(F.col(text)).alias("key"),
    ), "rows")
    summed = rows.groupBy("key").agg(F.sum("size").alias("size"))
    groups = stage(shuffle(summed, key="key"), "groups")  # in ranges of the key
    bounds = shard_bounds(groups, shards)
    shard = F.lit(0)
    for i, key in enumerate(bounds, 1):
        shard = F.when(F.col("key") >= key, i).otherwise(shard)
    cell = F.pmod(F.xxhash64("doc_id", "size"), F.lit(CELLS)).cast("int")
    placed = rows.withColumns({"shard": shard.cast("int"), "cell": cell})
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    offsets = stage(counts.withColumn("before", before).drop("n"), "offsets")  # at most shards x CELLS rows
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key"))
    return placed.withColumn("at", inside).join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("before") + F.col("at") - 1).alias("slot")
    )
