"""Words, lines and runs of them over whole Arrow slices, as numpy arrays.

Byte positions of all words of a slice are found at once; a word's hash is the difference of two
prefix sums of a polynomial modulo 2**64, mixed at the end. Runs of words are hashed the same way
over word hashes. Two seeds together give 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = bytes([0x20, *range(0x09, 0x0E)])
_MULTIPLIER = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict = {}


def byte_table(chosen) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


NOT_SPACE = ~byte_table(SPACE)
#: digits, lower-case letters and everything beyond ASCII
PLAIN = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NOT_NEWLINE = ~byte_table(b"\n")


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D + 2 * seed))


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier, and of its inverse."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        base, size = _MULTIPLIER[seed], 1 << max(10, (n - 1).bit_length())
        made = []
        for step in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers[seed] = tuple(made)
    a, b = _powers[seed]
    return a[:n], b[:n]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    up, down = powers(len(values) + 1, seed)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  #: index of each text's first word, and the number of words at the end

    def hashes(self, seed: int = 0) -> np.ndarray:
        values = _byte_values(seed)[self.data]
        return run_hash(values, self.starts, self.ends, seed)

    def grams(self, hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of k words from each word on; runs that leave the slice count as zero."""
        n = len(hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            at = np.arange(n - k + 1)
            out[: n - k + 1] = run_hash(hashes, at, at + k, seed)
        return out

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """Words from each word on to the end of its text."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the set ``inside`` that do not leave their text."""
    m = inside[data]
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    filled = np.flatnonzero(np.diff(offsets))
    edge = offsets[filled]
    start[edge] = m[edge]
    edge = offsets[filled + 1] - 1
    end[edge] = m[edge]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def lower(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def lines(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Each text cut at newlines, empty lines included; an empty text is one empty line."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    counts = 1 + np.searchsorted(cut, offsets[1:]) - np.searchsorted(cut, offsets[:-1])
    return Words(data, starts, ends, np.concatenate([[0], np.cumsum(counts)]))


def window_minima(order: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the least of order[i : i + width], the leftmost of equals."""
    n = len(order) - width + 1
    best = np.arange(max(n, 0))
    least = order[: max(n, 0)].copy()
    for step in range(1, width):
        other = order[step : step + n]
        less = other < least
        least[less] = other[less]
        best[less] = np.flatnonzero(less) + step
    return best


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of n words lie in any of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
