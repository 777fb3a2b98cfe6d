"""Line dedup by winnowing over line hashes.

A run of ``gram + window - 1`` lines that also occurs at an earlier position, by document id and line
number, is deleted where it occurs later. Grams of lines are hashed, and of each ``window``
neighbouring grams the least is the fingerprint: a run has the same one wherever it is, so none can be
missed. With ``passage``, a run of fewer lines counts too if it has more than that many words (divided
by white space), so that long passages of one or two lines go and short common lines stay; such a run
is its own fingerprint.

1. ``repeated``: only the selected minima are sent, to find the fingerprints that stand at two places.
2. ``later_runs``: where such a fingerprint stands, the match is extended both ways over the rest of
   its windows by the hashes of the lines there, and positions are joined on fingerprint and
   extension: all but the first are later copies. Neighbouring windows make up longer runs.
3. ``remove_lines``: the deletions of a document meet its text.

Only hashes and positions are compared. Each task first settles the copies in its share and sends one
row for a fingerprint or an extended run. Fingerprints that many different runs share, as of a common
header, are dealt by fingerprint and extension. A task holds its share of the positions, about 40
bytes each, so ``spark.sql.shuffle.partitions`` must grow with the input as for any shuffle.

Lines end at a newline only and are compared as they are, however long; an empty text is one empty
line, a null text none. Runs of empty lines count as any other. A document with a null id loses nothing
and is no source. Rows that share an id lose the lines whose run also stands further up under that id,
but not each other's lines of the same number. Empty tables give no rows. Columns named like a result
are replaced; all others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.frames import slices, text_bytes, without
from millrace.llm.words import NOT_SPACE, Words, covered, lines, mix, per_text, run_hash, window_minima


def word_counts(text: Words) -> np.ndarray:
    """How many words each line has."""
    inside = NOT_SPACE[text.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = text.starts[text.starts < text.ends]
    begins[edge] = inside[edge]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[text.ends] - total[text.starts]


def runs_of(text: Words, gram: int, window: int, passage: int | None = None):
    """(first line, text, fingerprint, key, lines) of each run of gram + window - 1 lines, and of each
    shorter run of more than ``passage`` words, in order of first lines."""
    size = gram + window - 1
    own, other = text.hashes(0), text.hashes(1)
    least = window_minima(text.grams(own, gram), window)
    start = np.flatnonzero(text.room()[: len(least)] >= size)
    mark = text.grams(own, gram)[least[start]]
    # what lies before and after the fingerprint, as part of the whole run
    key = run_hash(other, start, start + size, 1)
    made = [(start, mark, key, np.full(len(start), size))]
    if passage is not None:
        total, room = np.concatenate([[0], np.cumsum(word_counts(text))]), text.room()
        for n in range(1, size):
            start = np.flatnonzero(room >= n)
            start = start[total[start + n] - total[start] > passage]
            key = mix(run_hash(other, start, start + n, 1) + np.uint64(n))
            made.append((start, run_hash(own, start, start + n, 0), key, np.full(len(start), n)))
    start, mark, key, count = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(start, kind="stable")
    start = start[order]
    return start, np.searchsorted(text.first, start, side="right") - 1, mark[order], key[order], count[order]


def fingerprints_of(text: Words, gram: int, window: int, passage: int | None = None):
    """(fingerprint, text) of each selected minimum, and of each shorter run of more than ``passage`` words."""
    size = gram + window - 1
    own, room = text.hashes(0), text.room()
    grams = text.grams(own, gram)
    least = window_minima(grams, window)
    at = np.unique(least[room[: len(least)] >= size])
    made = [(grams[at], at)]
    if passage is not None:
        total = np.concatenate([[0], np.cumsum(word_counts(text))])
        for n in range(1, size):
            at = np.flatnonzero(room >= n)
            at = at[total[at + n] - total[at] > passage]
            made.append((run_hash(own, at, at + n, 0), at))
    mark, at = (np.concatenate(x) for x in zip(*made))
    return mark, np.searchsorted(text.first, at, side="right") - 1


def _later(mark, key, doc, line):
    """The first position of each run, and all others."""
    order = np.lexsort((line, doc, key, mark))
    mark, key, doc, line = mark[order], key[order], doc[order], line[order]
    first = np.ones(len(mark), bool)
    first[1:] = (mark[1:] != mark[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(first) - 1
    where = np.flatnonzero(first)[group]
    later = (doc != doc[where]) | (line != line[where])
    return (mark[first], key[first], doc[first], line[first]), (doc[later], line[later], name_of(mark, key, line)[later])


def name_of(mark, key, line) -> np.ndarray:
    """Name of a run and its line inside a document."""
    return mix(mix(mark ^ (key * np.uint64(0x9FB21C651E98DF25))) ^ line.astype(np.uint64)).view(np.int64)


def _lists(part, columns, names):
    """One row of lists for each part, to be dealt by it."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    made = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c[order].view(np.int64))) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), *made], names=["part", *names])


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy()


def _rows(columns, names):
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=names)


def repeated(docs: DataFrame, doc_id: str, text: str, gram: int, window: int, passage: int | None = None, gather: int = 1 << 19) -> DataFrame:
    """doc, mark of each fingerprint that stands at more than one position."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        held, n = [], 0

        def flush():
            mark, doc = (np.concatenate(x) for x in zip(*held))
            values, place, count = np.unique(mark, return_inverse=True, return_counts=True)
            again = count[place] > 1
            known = np.unique(np.stack([mark[again].view(np.int64), doc[again]], axis=1), axis=0) if again.any() else np.empty((0, 2), np.int64)
            if len(values):  # one row a fingerprint; its document is still to be told only if it stands alone here
                one = np.zeros(len(values), np.int64)
                one[place] = doc
                yield _lists(values % np.uint64(parts), (values, one, (count > 1).astype(np.int64)), ("mark", "doc", "known"))
            if len(known):  # settled here
                mark, doc = known.T.copy()
                out = _lists(mix(mark.view(np.uint64) ^ mix(doc.view(np.uint64))) % np.uint64(parts), (mark, doc, mark), ("mark", "doc", "known"))
                yield out.set_column(3, "known", pa.nulls(out.num_rows, pa.list_(pa.int64())))

        for batch in slices(batches, text):
            cut = lines(*text_bytes(batch.column(text)))
            mark, owner = fingerprints_of(cut, gram, window, passage)
            ids = batch.column(doc_id).to_numpy(zero_copy_only=False)
            held.append((mark, ids[owner].astype(np.int64)))
            n += len(mark)
            if n >= gather:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def settle(batches):
        held = []
        for batch in batches:
            done = batch.filter(batch.column("known").is_null())
            yield from _rows((_flat(done.column("doc")), _flat(done.column("mark"))), ("doc", "mark"))
            part = batch.filter(batch.column("known").is_valid())
            held.append(tuple(_flat(part.column(c)) for c in ("mark", "doc", "known")))
        if held:
            mark, doc, known = (np.concatenate(x) for x in zip(*held))
            _, place, count = np.unique(mark, return_inverse=True, return_counts=True)
            told = (count[place] > 1) & (known == 0)
            yield from _rows((doc[told], mark[told]), ("doc", "mark"))

    kinds = "part int, mark array<long>, doc array<long>, known array<long>"
    return docs.mapInArrow(send, kinds).repartitionById(parts, F.col("part")).mapInArrow(settle, "doc long, mark long")


def later_runs(docs: DataFrame, doc_id: str, text: str, marks: str, gram: int, window: int, passage: int | None = None,
               gather: int = 1 << 19) -> DataFrame:
    """doc, line, name of each run that occurs earlier too, among those whose fingerprint is one of the row's ``marks``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("mark", "key", "doc", "line")

    def send(batches):
        held, n = [], 0

        def flush():
            first, (doc, line, name) = _later(*(np.concatenate(x) for x in zip(*held)))
            if len(first[0]):  # by the extension too: a common fingerprint is spread over its different runs
                yield _lists(mix(first[0] ^ mix(first[1])) % np.uint64(parts), first, names)
            if len(doc):  # settled here: passed on without a fingerprint
                out = _lists(name.view(np.uint64) % np.uint64(parts), (name, name, doc, line), names)
                yield out.set_column(1, "mark", pa.nulls(out.num_rows, pa.list_(pa.int64())))

        for batch in slices(batches, text):
            cut = lines(*text_bytes(batch.column(text)))
            start, owner, mark, key, _ = runs_of(cut, gram, window, passage)
            found = batch.column(marks)
            of, known = found.value_lengths().to_numpy(), _flat(found).view(np.uint64)
            salt = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))  # a mark is repeated for its own document
            hit = np.isin(mark ^ salt[owner], known ^ np.repeat(salt, of))
            start, owner, mark, key = start[hit], owner[hit], mark[hit], key[hit]
            ids = batch.column(doc_id).to_numpy(zero_copy_only=False)
            held.append((mark, key, ids[owner].astype(np.int64), start - cut.first[owner]))
            n += len(start)
            if n >= gather:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def settle(batches):
        held = []
        for batch in batches:
            known = batch.filter(batch.column("mark").is_null())
            yield from _rows(tuple(_flat(known.column(c)) for c in ("doc", "line", "key")), ("doc", "line", "name"))
            part = batch.filter(batch.column("mark").is_valid())
            mark, key, doc, line = (_flat(part.column(c)) for c in names)
            held.append((mark.view(np.uint64), key.view(np.uint64), doc, line))
        if held:
            yield from _rows(_later(*(np.concatenate(x) for x in zip(*held)))[1], ("doc", "line", "name"))

    kinds = "part int, mark array<long>, key array<long>, doc array<long>, line array<long>"
    return docs.mapInArrow(send, kinds).repartitionById(parts, F.col("part")).mapInArrow(settle, "doc long, line long, name long")


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = 2, window: int = 2,
                 passage: int | None = None) -> DataFrame:
    """The documents with later repeated runs of lines deleted from the text, n_lines and n_removed."""
    if gram < 1 or window < 1:
        raise ValueError("gram and window must be positive")
    docs = without(docs, "n_lines", "n_removed", "_doc", "_names")
    keep = docs.columns
    number = F.col(doc_id).cast("long")
    ids = docs.select(number.alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    marks = repeated(ids, "id", "text", gram, window, passage).groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    matched = ids.join(marks, F.col("id") == F.col("doc")).select("id", "text", "marks")
    runs = later_runs(matched, "id", "text", "marks", gram, window, passage)
    found = runs.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("name").alias("_names"))
    joined = docs.join(found, number == F.col("_doc"), "left").drop("_doc")
    place = keep.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in slices(batches, text):
            column = batch.column(text)
            cut = lines(*text_bytes(column))
            gone = np.zeros(len(cut.starts), bool)
            texts, names = column.to_pylist(), batch.column("_names").to_pylist()
            if any(names):
                start, owner, mark, key, size = runs_of(cut, gram, window, passage)
                own = name_of(mark, key, start - cut.first[owner])
                bounds, hits = np.searchsorted(owner, np.arange(len(texts) + 1)), []
                for d, known in enumerate(names):
                    if known:
                        a, b = bounds[d], bounds[d + 1]
                        hits.append(a + np.flatnonzero(np.isin(own[a:b], np.array(known, np.int64))))
                hits = np.concatenate(hits)
                gone = covered(start[hits], size[hits], len(gone))
            removed = per_text(gone, cut.first)
            for d in np.flatnonzero(removed).tolist():
                kept = [x for x, g in zip(texts[d].split("\n"), gone[cut.first[d] : cut.first[d + 1]]) if not g]
                texts[d] = "\n".join(kept)
            count = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(cut.first), 0)
            columns = [batch.column(c) for c in keep]
            columns[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(removed, pa.int64())], names=[*keep, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)
