"""Repeated substrings of each text by a suffix array over its words.

All words of an Arrow slice become numbers, equal only for equal words of one text, so that one suffix array
serves the whole slice and no match leaves its text. Suffixes are ordered by prefix doubling: a round sorts
those that still share their first 2**k words with another. The longest common prefix of neighbours in that
order follows from the ranks of the rounds, and the greater one of a suffix's two is its longest repeat. A
repeat is maximal if the suffix before it, one word longer, is not one as well. Spans of maximal repeats of
at least ``least`` words are united.

A text is rejected if its spans cover more than ``most_covered`` per cent of its words, or if a repeat has
more than ``longest`` words. Overlapping repeats count ("a a a" repeats "a a").

Words are the maximal runs of what is not white space; they are compared byte by byte. A null text has no
words and repeats nothing, nor has an empty one; both are kept by this rule. Very long texts are a slice of
their own: about 40 bytes a word and round. Rows are judged one by one, so ties, repeated rows and null
ids change nothing. Empty tables give no rows. Columns named like a result are replaced; all others are
kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.frames import map_slices, text_bytes, without
from millrace.llm.words import NOT_SPACE, SPACE, byte_table, covered, find, mix, per_text

LEAST, MOST_COVERED, LONGEST = 4, 40, 50
WINDOW = 8  # words of the base rule's windows
SYMBOLS = byte_table(b"#*$%&|<>")
_WHITE = SPACE.decode()


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place how many symbols from there on also stand at another place."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    _, first = np.unique(symbols, return_inverse=True)
    # ranks[k][i]: place, from 1, of the 2**k symbols from i on, that of the first of equals; the end sorts first
    counts = np.bincount(first)
    ranks, size = [((np.cumsum(counts) - counts)[first] + 1).astype(np.int32)], 1
    while True:
        rank = ranks[-1]
        shared = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(shared):
            break
        behind = np.zeros(len(shared), np.int32)
        inside = shared + size < n
        behind[inside] = rank[shared[inside] + size]
        key = rank[shared].astype(np.int64) << 32 | behind
        order = np.argsort(key, kind="stable")
        key, at = key[order], shared[order]
        fresh = np.append(True, key[1:] != key[:-1])
        group = np.append(True, key[1:] >> 32 != key[:-1] >> 32)
        begin = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
        offset = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) - begin
        made = rank.copy()
        made[at] = rank[at] + offset
        ranks.append(made)
        size *= 2
    if len(ranks) == 1:
        return np.zeros(n, np.int64)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[ranks[k][x[inside]] == ranks[k][y[inside]]]
        common[same] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def maximal(longest: np.ndarray, least: int) -> np.ndarray:
    """Places where a repeat of at least ``least`` begins that is not the rest of one that begins a place earlier."""
    before = np.append(0, longest[:-1])
    return np.flatnonzero((longest >= least) & (before <= longest))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_lines(text: str | None) -> int:
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(_WHITE):
            n += line in seen
            seen.add(line)
    return n


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in repeats of ``window`` words or more),
    n_covered (the same for ``least``), longest_repeat, and spans (start, end) of words, united."""
    if least < 1 or window < 1:
        raise ValueError("repeats have at least one word")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    docs = without(docs, *names, "spans")
    keep = docs.columns if keep is None else keep

    def work(batch):
        column = batch.column(text)
        data, offsets = text_bytes(column)
        words = find(data, offsets, NOT_SPACE)
        n, owner = len(words.starts), words.texts()
        symbols = words.hashes(0) ^ mix(owner.astype(np.uint64) + np.uint64(1))
        longest = longest_repeats(symbols)
        starts = maximal(longest, window)
        windows = covered(starts, longest[starts], n)
        starts = maximal(longest, least)
        inside = covered(starts, longest[starts], n)
        most = np.zeros(len(column), np.int64)
        np.maximum.at(most, owner, longest)
        # edges of the united spans; a span never leaves its text
        edge = np.append(True, owner[1:] != owner[:-1]) if n else np.zeros(0, bool)
        begin = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[:n] | edge))
        last = np.append(edge[1:], True)[:n] | np.append(~inside[1:], True)[:n]
        end = np.flatnonzero(inside & last) + 1
        base = words.first[owner[begin]]
        rows = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "end"])
        at = np.searchsorted(begin, words.first).astype(np.int32)
        code_points = (data & 0xC0) != 0x80
        lines = np.fromiter((_repeated_lines(t) for t in column.to_pylist()), np.int64, len(column))
        counts = (
            np.diff(words.first), _sums(code_points & NOT_SPACE[data], offsets), _sums(SYMBOLS[data], offsets), lines,
            per_text(windows, words.first), per_text(inside, words.first), most,
        )
        return [*(pa.array(c, pa.int64()) for c in counts), pa.ListArray.from_arrays(pa.array(at), rows)]

    added = [*(T.StructField(c, T.LongType()) for c in names), T.StructField("spans", span)]
    return map_slices(docs, text, work, keep, added)


def base_failed() -> Column:
    """Too short, or mostly repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def within_limits(most_covered: int = MOST_COVERED, longest: int = LONGEST) -> Column:
    return (100 * F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST,
          most_covered: int = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """The measures, base_failed, and kept: neither failed nor beyond the limits on repeats."""
    made = measure(without(docs, "base_failed", "kept"), text, keep, least).withColumn("base_failed", base_failed())
    return made.withColumn("kept", ~F.col("base_failed") & within_limits(most_covered, longest))
