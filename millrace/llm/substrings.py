"""Substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of a document. A word is removed if a window over it also
starts in a document with a smaller id. Words and windows of all documents are judged, as read.

1. Candidates. Each window has one *anchor*, the least of its word grams (winnowing), so two equal
   windows have the same one. Neighbouring windows with the same anchor form a *run* of words. Only
   the hashes of anchors and runs travel. A run seen in a smaller document is removed whole. Runs
   left over that share an anchor with a different run, in another document, stay open.
2. Reference shards. The words of open runs are dealt to shards by anchor. Each shard's suffix
   automaton holds, for each state, the least document it occurs in. The runs are streamed through
   it; where the matching statistic reaches the window, the state says whether a smaller document
   has it. A shard holds about ``shard_words`` words, which bounds the memory of a task.
3. The spans found go back to their documents, whose words outside them are kept.

The automata hold open runs instead of whole documents: a shard of the corpus against the whole
corpus would cost the square of the input. What the first step settles are runs that are equal word
for word (by 128 bits of hashes), for which an automaton could say nothing else.

Copies within a task's share are settled there, so of a run in very many documents each task sends
one. Grams that are frequent in a bounded sample of documents are the last choice for an anchor,
which spreads their many different surroundings; the result does not depend on the sample.

A null or wordless text has no words and loses none. A document with a null id loses nothing and is no
reference. Repeated rows of an id do not remove each other. Tables may be empty. Only the id and the
text are read; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.frames import map_slices, slices, text_bytes
from millrace.llm.words import NOT_SPACE, Words, covered, find, mix, per_text, run_hash, window_minima
from millrace.session import stage

GRAM = 5
WHOLE = -1  # mask of a run that is removed whole


@dataclass
class Runs:
    """Runs of windows with one anchor."""

    start: np.ndarray  #: first word
    windows: np.ndarray  #: how many windows
    text: np.ndarray
    anchor: np.ndarray
    body: np.ndarray

    def keys(self) -> np.ndarray:
        """Name of a run inside its document."""
        return key_of(self.anchor, self.body)


def key_of(anchor: np.ndarray, body: np.ndarray) -> np.ndarray:
    return mix(anchor ^ (body * np.uint64(0x9FB21C651E98DF25))).view(np.int64)


def runs_of(words: Words, window: int, hot: np.ndarray) -> Runs:
    gram = min(GRAM, window)
    hashes = words.hashes()
    grams = words.grams(hashes, gram, 1)
    order = grams >> np.uint64(1)
    if len(hot):
        order[np.isin(grams, hot)] |= np.uint64(1 << 63)
    least = window_minima(order, window - gram + 1)
    starts = np.flatnonzero(words.room()[: len(least)] >= window)
    anchor = least[starts]
    fresh = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))) if len(starts) else np.empty(0, np.int64)
    windows = np.diff(np.append(fresh, len(starts)))
    start, at = starts[fresh], anchor[fresh]
    text = np.searchsorted(words.first, start, side="right") - 1
    return Runs(start, windows, text, grams[at], run_hash(hashes, start, start + windows + window - 1, 0))


def frequent_grams(docs: DataFrame, text: str, window: int, sample: int = 2048, share: float = 0.01, limit: int = 10_000) -> np.ndarray:
    """Grams in over ``share`` of about ``sample`` documents, ``limit`` at most. Guides the choice of
    anchors only."""
    n = docs.count()
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.length(text)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(n, 1)))))

    def count(batches):
        for batch in slices(batches, text):
            words = find(*text_bytes(batch.column(text)), NOT_SPACE)
            grams = words.grams(words.hashes(), min(GRAM, window), 1)
            pairs = np.unique(np.stack([words.texts().astype(np.uint64), grams], axis=1), axis=0) if len(grams) else np.empty((0, 2), np.uint64)
            seen, n = np.unique(pairs[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], names=["gram", "n"])

    counted = chosen.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(3, int(min(n, sample) * share))
    rows = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(limit).collect()
    return np.array([r["gram"] for r in rows], np.int64).view(np.uint64)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal rows begins, in sorted columns."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _least_first(anchor, body, doc):
    """Of each run the least document; of its other documents (doc, key)."""
    order = np.lexsort((doc, body, anchor))
    anchor, body, doc = anchor[order], body[order], doc[order]
    keep = _groups(anchor, body, doc)
    anchor, body, doc = anchor[keep], body[keep], doc[keep]
    first = _groups(anchor, body)
    return (anchor[first], body[first], doc[first]), (doc[~first], key_of(anchor[~first], body[~first]))


def _listed(part, *columns):
    """One row of lists for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.append(np.flatnonzero(_groups(part)), len(part)) if len(part) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c[order].view(np.int64))) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), *lists], names=["part", "anchors", "bodies", "docs"])


def candidates(docs: DataFrame, doc_id: str, text: str, window: int, hot: np.ndarray, gather: int = 1 << 20) -> DataFrame:
    """doc, key, open: runs of a document that are removed whole, or else open."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        held, n = [], 0

        def flush():
            first, (doc, key) = _least_first(*(np.concatenate(x) for x in zip(*held)))
            yield _listed(first[0] % np.uint64(parts), *first)
            if len(doc):  # already known here: bodies and docs without anchors
                out = _listed((mix(doc.view(np.uint64)) % np.uint64(parts)), key, key, doc)
                yield out.set_column(1, "anchors", pa.nulls(out.num_rows, pa.list_(pa.int64())))

        for batch in slices(batches, text):
            ids = batch.column(doc_id).to_numpy(zero_copy_only=False)
            runs = runs_of(find(*text_bytes(batch.column(text)), NOT_SPACE), window, hot)
            held.append((runs.anchor, runs.body, ids[runs.text].astype(np.int64)))
            n += len(runs.anchor)
            if n >= gather:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def settle(batches):
        names, held = ["doc", "key", "open"], []

        def rows(doc, key, still):
            for i in range(0, len(doc), 1 << 16):
                d, k = doc[i : i + (1 << 16)], key[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(np.full(len(d), still))], names=names)

        def flat(column):
            return column.flatten().to_numpy()

        for batch in batches:
            known = batch.filter(batch.column("anchors").is_null())
            yield from rows(flat(known.column("docs")), flat(known.column("bodies")), False)
            part = batch.filter(batch.column("anchors").is_valid())
            held.append((flat(part.column("anchors")).view(np.uint64), flat(part.column("bodies")).view(np.uint64), flat(part.column("docs"))))
        if held:
            (anchor, body, doc), gone = _least_first(*(np.concatenate(x) for x in zip(*held)))
            yield from rows(*gone, False)
            if len(doc):
                begin = np.flatnonzero(_groups(anchor))
                size = np.diff(np.append(begin, len(anchor)))
                several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
                still = np.repeat(several, size)
                yield from rows(doc[still], key_of(anchor[still], body[still]), True)

    lists = "part int, anchors array<long>, bodies array<long>, docs array<long>"
    sent = docs.filter(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(send, lists)
    return sent.repartitionById(parts, F.col("part")).mapInArrow(settle, "doc long, key long, open boolean")


class Automaton:
    """Suffix automaton of several word sequences; ``first`` is the least document of a state."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [1 << 63]

    def add(self, words, doc: int) -> None:
        follow, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            p, q = last, follow[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                fresh = q is None
                if fresh:
                    cur = len(length)
                    follow.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    first.append(1 << 63)
                    while p >= 0 and w not in follow[p]:
                        follow[p][w] = cur
                        p = link[p]
                    last = cur
                    if p >= 0:
                        q = follow[p][w]
                if p >= 0:
                    if length[q] == length[p] + 1:
                        link[last] = q
                    else:
                        copy = len(length)
                        follow.append(follow[q].copy())
                        link.append(link[q])
                        length.append(length[p] + 1)
                        first.append(first[q])
                        while p >= 0 and follow[p].get(w) == q:
                            follow[p][w] = copy
                            p = link[p]
                        link[q] = copy
                        if fresh:
                            link[last] = copy
                        else:
                            last = copy
            if doc < first[last]:
                first[last] = doc

    def settle(self) -> None:
        """A state occurs wherever the longer ones that it ends do."""
        link, first = self.link, self.first
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = link[s]
            if up >= 0 and first[s] < first[up]:
                first[up] = first[s]

    def statistics(self, words, window: int):
        """For each word that ends a match of the window: (its place, least document of it)."""
        follow, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in follow[state]:
                state = link[state]
                matched = length[state]
            if w in follow[state]:
                state, matched = follow[state][w], matched + 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                yield i, first[state]


def _resolve(window: int):
    def shard(group: pa.Table) -> pa.Table:
        docs, keys = group.column("doc").to_pylist(), group.column("key").to_pylist()
        numbers: dict[str, int] = {}
        runs = [[numbers.setdefault(w, len(numbers)) for w in words.split(" ")] for words in group.column("words").to_pylist()]
        automaton = Automaton()
        for run, doc in zip(runs, docs):
            automaton.add(run, doc)
        automaton.settle()
        out = []
        for run, doc, key in zip(runs, docs, keys):
            mask = sum(1 << (i - window + 1) for i, least in automaton.statistics(run, window) if least < doc)
            if mask:
                out.append((doc, key, mask))
        return pa.table(dict(zip(("doc", "key", "mask"), (pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))))))

    return shard


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id and compressed text, for the shuffles of whole texts."""
    def work(batch):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return [pa.array([None if t is None else pack(t.encode()) for t in batch.column(text).to_pylist()], pa.binary())]

    return map_slices(docs, text, work, [doc_id], [T.StructField("packed", T.BinaryType())])


def _unpacked(batch):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    size, part = 0, []
    for row in batch.to_pylist():
        row["text"] = b"" if row["packed"] is None else unpack(row["packed"])
        part.append(row)
        size += len(row["text"])
        if size >= 1 << 20:
            yield part
            size, part = 0, []
    if part:
        yield part


def _words(rows) -> Words:
    offsets = np.concatenate([[0], np.cumsum([len(r["text"]) for r in rows])]).astype(np.int64)
    return find(np.frombuffer(b"".join(r["text"] for r in rows), np.uint8), offsets, NOT_SPACE)


def _marked(runs: Runs, rows, field: str):
    """(run, row, place in the row's list) of the runs named in the rows' lists."""
    keys, bounds = runs.keys(), np.searchsorted(runs.text, np.arange(len(rows) + 1))
    for d, row in enumerate(rows):
        if row[field]:
            own = keys[bounds[d] : bounds[d + 1]]
            known = np.array(row[field], np.int64)
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known[order], own), len(known) - 1)
            hit = np.flatnonzero(known[order][at] == own)
            yield d, bounds[d] + hit, order[at[hit]]


def open_runs(docs: DataFrame, found: DataFrame, doc_id: str, text: str, window: int, hot: np.ndarray, shards: int) -> DataFrame:
    """shard, doc, key, words of each open run, once."""
    lists = found.filter("open").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    joined = packed(docs, doc_id, text).join(lists, F.col(doc_id) == F.col("doc")).select("doc", "packed", "keys")

    def run(batches):
        for batch in batches:
            for rows in _unpacked(batch):
                words = _words(rows)
                runs, data, out, seen = runs_of(words, window, hot), words.data.tobytes(), [], set()
                for d, hit, _ in _marked(runs, rows, "keys"):
                    doc, keys = rows[d]["doc"], runs.keys()[hit].tolist()
                    shard = (runs.anchor[hit] % np.uint64(shards)).tolist()
                    first, last = runs.start[hit], runs.start[hit] + runs.windows[hit] + window - 2
                    for s, k, a, b in zip(shard, keys, words.starts[first].tolist(), words.ends[last].tolist()):
                        if (doc, k) not in seen:
                            seen.add((doc, k))
                            out.append((s, doc, k, b" ".join(data[a:b].split()).decode("utf-8", "replace")))
                columns = zip(*out) if out else ((), (), (), ())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "doc", "key", "words"])

    return joined.mapInArrow(run, "shard int, doc long, key long, words string")


def removed_runs(docs: DataFrame, doc_id: str, text: str, window: int, hot: np.ndarray, shard_words: int) -> DataFrame:
    """doc, key, mask: a run and which of its windows are removed."""
    found = stage(candidates(docs, doc_id, text, window, hot), "candidates")
    total = found.filter("open").count()
    shards = max(1, -(-total * (window + 4) // shard_words))
    runs = open_runs(docs, found, doc_id, text, window, hot, shards)
    resolved = stage(runs.groupBy("shard").applyInArrow(_resolve(window), "doc long, key long, mask long"), "resolved")
    return found.filter("not open").select("doc", "key", F.lit(WHOLE).cast("long").alias("mask")).unionByName(resolved)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, shard_words: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space), one per row."""
    if not 1 <= window <= 60:
        raise ValueError("window must be from 1 to 60 words")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    doc_id, text = "doc_id", "text"
    hot = frequent_grams(docs, text, window)
    removed = removed_runs(docs, doc_id, text, window, hot, shard_words)
    lists = removed.groupBy("doc").agg(F.collect_list("key").alias("keys"), F.collect_list("mask").alias("masks"))
    joined = packed(docs, doc_id, text).join(lists, F.col(doc_id) == F.col("doc"), "left").select(doc_id, "packed", "keys", "masks")

    def run(batches):
        for batch in batches:
            for rows in _unpacked(batch):
                words = _words(rows)
                n, starts = len(words.starts), []
                runs = runs_of(words, window, hot) if any(r["keys"] for r in rows) else None
                for d, hit, at in _marked(runs, rows, "keys") if runs else ():
                    mask = np.array(rows[d]["masks"], np.int64)[at]
                    for j in range(int(runs.windows[hit].max()) if len(hit) else 0):
                        gone = ((mask >> j) & 1).astype(bool) & (j < runs.windows[hit])
                        starts.append(runs.start[hit[gone]] + j)
                gone = covered(np.concatenate(starts) if starts else np.empty(0, np.int64), window, n)
                kept = []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    kept.append(b" ".join(_spans(words, a, b, gone)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(np.diff(words.first), pa.int64()),
                     pa.array(per_text(gone, words.first), pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _spans(words: Words, a: int, b: int, gone: np.ndarray):
    """The kept words of a text, spans of them at once."""
    flags = np.concatenate([[True], gone[a:b], [True]])
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield b" ".join(words.data[words.starts[a + i] : words.ends[a + j - 1]].tobytes().split())
