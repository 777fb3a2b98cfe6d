"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of ``window`` words; a shorter item is one window. The
words of all items are counted in every document, which orders them by rarity. A window can only
be contained in a document that has its rarest word, so that word alone is the necessary prefix
of exact containment: document words are joined with the prefixes, the window's start is bounded
by the prefix word's place in it (start at or after the first word, room for the whole window),
and the words of what is left are compared one by one.

Items are sent to tasks in blocks of at most ``block_windows`` windows; documents stay where they
are, and a further block is a further pass. Nothing is emitted per pair.

Null or wordless documents have no words and no hits, null or wordless items no windows. Items with
a null id mark words but are not listed. Repeated rows are judged each for itself, and empty tables
give no hits or no rows. Input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.frames import lower_ascii, map_slices, slices, text_bytes
from millrace.llm.words import PLAIN, Words, covered, find, lower, per_text
from millrace.session import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_hit", "items", "contaminated")
_STATE = ("_hit", "_found")


def item_windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """window (words), items (their ids): each distinct window once."""
    cut = items.select(
        F.col(item_id).cast("string").alias("id"),
        F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(WORD), F.lit(0)).alias("words"),
    ).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    each = cut.select("id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, window))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("id")).alias("items"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return Words(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, np.array([0, len(words)])).hashes()


def count_words(docs: DataFrame, text: str, vocabulary: np.ndarray) -> DataFrame:
    """key, n: how often the words with the given sorted hashes occur in all documents."""
    def run(batches):
        known, total = vocabulary, np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches, text):
            data, offsets = text_bytes(batch.column(text))
            hashes = find(lower(data), offsets, PLAIN).hashes()
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            total += np.bincount(at[known[at] == hashes], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["key", "n"])

    counted = docs.select(text).mapInArrow(run, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


class WindowIndex:
    """Windows by the hash of their rarest word."""

    def __init__(self, windows: list[list[bytes]], items: list[list[str]], counts: dict[bytes, int]):
        self.words, self.items = windows, items
        self.length = np.array([len(w) for w in windows], np.int64)
        self.hashes = np.zeros((len(windows), int(self.length.max())), np.uint64)
        for i, w in enumerate(windows):
            self.hashes[i, : len(w)] = word_hashes(w)
        place = np.array([min(range(len(w)), key=lambda j: (counts.get(w[j], 0), w[j], j)) for w in windows])
        prefix = self.hashes[np.arange(len(windows)), place]
        order = np.argsort(prefix, kind="stable")
        self.window, self.place = order, place[order]
        self.prefix, first = np.unique(prefix[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.prefix >> np.uint64(48)] = True

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        hashes = text.hashes()
        near = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.prefix, hashes[near]), len(self.prefix) - 1)
        same = self.prefix[at] == hashes[near]
        near, at = near[same], at[same]
        n = self.bounds[at + 1] - self.bounds[at]
        entry = np.repeat(self.bounds[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        start, window = np.repeat(near, n) - self.place[entry], self.window[entry]
        # bounds: the whole window lies in the prefix word's text
        owner = np.repeat(np.searchsorted(text.first, near, side="right") - 1, n)
        fits = (start >= text.first[owner]) & (start + self.length[window] <= text.first[owner + 1])
        start, window = start[fits], window[fits]
        for j in range(self.hashes.shape[1]):
            inside = j < self.length[window]
            same = ~inside | (hashes[np.where(inside, start + j, 0)] == self.hashes[window, j])
            start, window = start[same], window[same]
        exact = np.array([all(text.word(s + j) == w for j, w in enumerate(self.words[k])) for s, k in zip(start.tolist(), window.tolist())], bool)
        return (start[exact], window[exact]) if len(exact) else (start, window)


def _mark(docs: DataFrame, index, text: str, keep: list[str]) -> DataFrame:
    again = [c for c in _STATE if c in docs.columns]

    def work(batch):
        data, offsets = text_bytes(batch.column(text))
        words = find(lower(data), offsets, PLAIN)
        n, first = len(words.starts), words.first
        start, window = index.search(words) if index else (np.empty(0, np.int64), np.empty(0, np.int64))
        hit = covered(start, index.length[window], n) if index else np.zeros(n, bool)
        owner = np.searchsorted(first, start, side="right") - 1
        found: dict[int, set] = {}
        for d, k in set(zip(owner.tolist(), window.tolist())):
            found.setdefault(d, set()).update(index.items[k])
        if again:
            for d, (bits, items) in enumerate(zip(batch.column("_hit").to_pylist(), batch.column("_found").to_pylist())):
                own = slice(first[d], first[d + 1])
                if bits:
                    hit[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=first[d + 1] - first[d]).astype(bool)
                    found.setdefault(d, set()).update(items)
        hits = per_text(hit, first)
        bits = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() if hits[d] else None for d in range(len(hits))]
        return [
            pa.array(np.diff(first), pa.int64()), pa.array(hits, pa.int64()), pa.array(bits, pa.binary()),
            pa.array([sorted(found.get(d, ())) for d in range(len(hits))], pa.list_(pa.string())),
        ]

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
             T.StructField("_hit", T.BinaryType()), T.StructField("_found", T.ArrayType(T.StringType()))]
    if not again:
        return map_slices(docs, text, work, keep, added)
    fresh = [T.StructField("new" + f.name, f.dataType) for f in added]
    made = map_slices(docs, text, work, [*keep, *again], fresh)
    return made.select(*keep, *[F.col("new" + f.name).alias(f.name) for f in added])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                  keep: list[str] | None = None, block_windows: int = 200_000) -> DataFrame:
    """Documents with n_words, n_hit (words inside benchmark windows), items (ids of the items they
    come from, sorted as strings) and contaminated. ``keep``: input columns to carry, default all."""
    spark = docs.sparkSession
    clash = {r.lower() for r in (*RESULTS, *_STATE)}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in clash]
    windows = stage(item_windows(items, window, item_id), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    made = docs
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).select("window", "items").collect()
        index = None
        if rows:
            texts = [[w.encode() for w in r["window"]] for r in rows]
            vocabulary = sorted({w for t in texts for w in t})
            hashes = word_hashes(vocabulary)
            order = np.argsort(hashes)
            counted = count_words(docs, text, hashes[order]).collect()
            counts = {vocabulary[order[r["key"]]]: r["n"] for r in counted}
            index = WindowIndex(texts, [r["items"] for r in rows], counts)
        carry = [*keep, *([text] if text not in keep and block < blocks - 1 else [])]
        made = _mark(made, index, text, carry)
        if block < blocks - 1:
            made = stage(made, "marked")
    return made.select(
        *keep, "n_words", "n_hit", F.col("_found").alias("items"), (F.col("n_hit") > 0).alias("contaminated")
    )
