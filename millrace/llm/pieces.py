"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled once, on the driver. Three transducers are composed:

* the normaliser: spaces become U+2581, one is put before a text that is not empty;
* the pieces: an arc for each piece, over a prefix tree of its characters, and for any other
  character the arcs of its UTF-8 bytes (byte fallback), or of the unknown piece;
* the weights: for a unigram model the negative score of a piece. For a byte-pair model an acceptor
  over neighbouring pieces, of weight zero where two pieces may meet and infinite elsewhere. They
  may meet if the merges of both, run side by side in order of score, are never overtaken by a
  merge across their border. A piece that its own merges do not produce has no arc.

The composition with an input is searched for its shortest path in the tropical semiring. With the
acceptor just one path is finite, for the whole input as for each prefix, and it is what the merges
would give; a position has but one state, so the composition is built lazily, depth first.

No piece continues from another character into U+2581, nor across a character that occurs in no
longer piece; the transducer is back in its start state there. Texts are composed segment by
segment, and the paths of recent short segments are kept. If a model has such a piece, its whole
text is one segment. Time is linear in the text, memory bounded by the longest text.

Decoding takes the paths' other side: pieces to bytes, U+2581 to a space, less the space put first.
A text comes back as it was unless it has U+2581 itself, or a normaliser that drops spaces.

Null texts have null ids, empty texts none. Rows are taken one by one, so repeated rows and null ids
of documents change nothing; input columns named like a result are replaced.
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.frames import map_slices

SPACE_MARK = "▁"
# --- fixed values: piece types and model types of the model file ----------------------------
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
KEPT_SEGMENTS = 1 << 17
KEPT_LENGTH = 48
KEPT_PAIRS = 1 << 19
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Paths(dict):
    """Codes of segments, all with the same lead. Short ones are kept in two generations: one in use moves on when the
    other is full."""

    def __init__(self, model=None, lead=""):
        self.model, self.lead, self.older = model, lead, {}

    def __missing__(self, segment: str) -> bytes:
        out = self.older.get(segment)
        if out is None:
            out = self.model.codes(self.lead + segment)
        if len(segment) <= KEPT_LENGTH:
            if len(self) >= KEPT_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[segment] = out
        return out


class Transducer:
    """The compiled model. Holds no open resource, so it is sent to tasks as it is."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds, self.kind, self.prefix, self.squeeze, fallback = [], [], UNIGRAM, True, True, False
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
                if f.get(24):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(2):
                    raise ValueError("a model with a character map is not supported")
        if self.kind not in (UNIGRAM, BPE) or USER_DEFINED in kinds:
            raise ValueError("only unigram and byte-pair models without symbols of their own are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE} if fallback else {}
        self.least = min(self.score.values()) - UNKNOWN_PENALTY
        self.merges = {}
        arcs = set(self.ids)
        if self.kind == BPE:
            self.merges = {i: m for p, i in self.ids.items() if (m := self._merges(p)) is not None}
            arcs = {self.pieces[i] for i in self.merges}
        tree: dict = {}
        for p in arcs:
            node = tree
            for c in p:
                node = node.setdefault(c, [None, {}])[1]
        for p in arcs:
            node, entry = tree, None
            for c in p:
                entry = node[c]
                node = entry[1]
            entry[0] = self.ids[p]
        self.root = tree  # a character leads to [the piece that ends there, further characters]
        self.surface = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE_MARK, " ").encode() if k == NORMAL
                        else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, kinds)]
        longer = [p for p in self.ids if len(p) > 1]
        self.inside = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        chars = {c for p in longer for c in p} - {SPACE_MARK}
        inner = re.escape("".join(sorted(chars)))
        # whole words and lines can be looked up when nothing crosses into a space or over a line's end
        self.by_word = bool(chars) and "\n" not in chars and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in longer)
        self.segment = re.compile(f"{SPACE_MARK}*[{inner}]+|{SPACE_MARK}+|[^{inner}{SPACE_MARK}]" if self.by_word else ".+", re.S)
        self.length = [len(p) for p in self.pieces]
        self.meet: dict[int, bool] = {}
        self.paths, self.words = Paths(self), Paths(self, SPACE_MARK)

    # ---- compiling -------------------------------------------------------------------------

    def _merges(self, piece: str):
        """Each merge of the piece's characters: (score, first symbol, last symbol) after it. None
        if they do not end in the piece."""
        parts, made, score = list(piece), [], self.score
        while len(parts) > 1:
            best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
            if best is None:
                return None
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            made.append((best[0], parts[0], parts[-1]))
        return made

    def _text(self, t: int) -> str:
        """Of a piece, or of a character that is none, which counts from the last piece on."""
        return self.pieces[t] if t < len(self.pieces) else chr(t - len(self.pieces))

    def may_meet(self, a: int, b: int) -> bool:
        left, right, i, j = self.merges.get(a, ()), self.merges.get(b, ()), 0, 0
        x, y, low = self._text(a)[-1], self._text(b)[0], float("-inf")
        while True:
            p = left[i][0] if i < len(left) else low
            q = right[j][0] if j < len(right) else low
            across = self.score.get(x + y, low)
            if across == p == q == low:
                return True
            if p >= across and p >= q:  # of equal merges the leftmost comes first
                x, i = left[i][2], i + 1
            elif across >= q:
                return False
            else:
                y, j = right[j][1], j + 1

    # ---- encoding --------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        text = text.replace(" ", SPACE_MARK)
        return SPACE_MARK + text if self.prefix and text else text

    def arcs(self, segment: str, i: int) -> list[int]:
        """Pieces from position i on, shortest first; a character that is none counts as one."""
        node, out = self.root, []
        for c in segment[i:]:
            entry = node.get(c)
            if entry is None:
                break
            t, node = entry
            if t is not None:
                out.append(t)
        if not out or self.length[out[0]] > 1:
            out.insert(0, len(self.pieces) + ord(segment[i]))
        return out

    def least_cost(self, segment: str) -> list[int]:
        """Shortest path by weights, for a unigram model."""
        n = len(segment)
        cost, last = [0.0] + [float("inf")] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            for t in self.arcs(segment, i):
                j = i + (self.length[t] if t < len(self.pieces) else 1)
                total = cost[i] - self.score.get(self._text(t), self.least)
                if total < cost[j]:
                    cost[j], last[j] = total, (t, i)
        path = []
        while n:
            t, n = last[n]
            path.append(t)
        return path[::-1]

    def finite(self, segment: str) -> list[int]:
        """The one path of finite weight, for a byte-pair model: longest arcs first. A position has
        but one finite state, so one that led nowhere is not entered again."""
        n, meet, length, lone = len(segment), self.meet, self.length, len(self.pieces)
        path, choices, dead, i = [], [], set(), 0
        while True:
            left = self.arcs(segment, i)
            while True:
                if left:
                    t = left.pop()
                    j = i + (length[t] if t < lone else 1)
                    if j in dead:
                        continue
                    if path:
                        key = path[-1] << 21 | t
                        fits = meet.get(key)
                        if fits is None:
                            if len(meet) >= KEPT_PAIRS:
                                meet.clear()
                            fits = meet[key] = self.may_meet(path[-1], t)
                        if not fits:
                            continue
                    path.append(t)
                    if j == n:
                        return path
                    choices.append(left)
                    i = j
                    break
                dead.add(i)
                t = path.pop()
                i -= length[t] if t < lone else 1
                left = choices.pop()

    def codes(self, segment: str) -> bytes:
        """The piece numbers of a segment, four bytes each. No piece holds two neighbours that are
        not neighbours in some piece, so the segment is cut between such."""
        inside, paths = self.inside, self.paths
        cuts = [] if segment[1:].isalpha() and len(segment) <= KEPT_LENGTH else [
            i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in inside]
        if cuts:
            parts = [segment[i:j] for i, j in zip([0, *cuts], [*cuts, len(segment)])]
            return b"".join([paths[p] for p in parts])
        found = self.finite(segment) if self.kind == BPE else self.least_cost(segment)
        lone = len(self.pieces)
        if max(found) < lone:
            return array("i", found).tobytes()
        out = array("i")
        for t in found:
            if t < lone:
                out.append(t)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(t - lone).encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """The piece numbers, four bytes each."""
        if not self.by_word or SPACE_MARK in text:
            return self._segments(self.normalise(text))
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        out = []
        for i, line in enumerate(text.split("\n") if text else ()):
            words = line.split(" ")
            if i:
                out.append(self.paths["\n"])
            if i or not self.prefix:
                if words[0]:
                    out.append(self.paths[words[0]])
                words = words[1:]
            if "" in words:
                out.append(self._segments(SPACE_MARK + SPACE_MARK.join(words)))
            else:
                out.extend(map(self.words.__getitem__, words))
        return b"".join(out)

    def _segments(self, text: str) -> bytes:
        return b"".join(map(self.paths.__getitem__, self.segment.findall(text)))

    def decode(self, ids) -> str:
        return self.shown(b"".join([self.surface[i] for i in ids]))

    def shown(self, data: bytes) -> str:
        """The text of joined surfaces: bytes that are no text are replaced, the first space goes."""
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def compile_model(model: str | bytes) -> Transducer:
    """From the content of a model file, or its path on the driver."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    return Transducer(model)


def share(docs: DataFrame, model: Transducer):
    """A function that gives the transducer in a task: one for each Python worker, which keeps its
    recent paths from task to task."""
    held = docs.sparkSession.sparkContext.broadcast({"model": cloudpickle.dumps(model)})

    def get() -> Transducer:
        own = held.value
        if "made" not in own:
            own["made"] = cloudpickle.loads(own["model"])
        return own["made"]

    return get


def encode(docs: DataFrame, model: Transducer, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Documents with ``ids``, the numbers of their pieces, and on request ``decoded``, the text of
    these ids: in the same task, which holds the transducer once for both ways."""
    get = share(docs, model)

    def work(batch):
        model, out, ends, missing = get(), [], [0], []
        for value in batch.column(text).to_pylist():
            missing.append(value is None)
            out.append(model.encode(value) if value else b"")
            ends.append(ends[-1] + len(out[-1]) // 4)
        values = pa.array(np.frombuffer(b"".join(out), np.int32))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(missing))
        return [ids, texts_of(ids, model)] if decoded else [ids]

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    names = {f.name for f in added}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    return map_slices(docs, text, work, keep, added)


def texts_of(ids: pa.ListArray, model: Transducer) -> pa.Array:
    """The texts of lists of pieces; null for null."""
    surface = pa.array(model.surface, pa.binary())
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
    runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), surface.take(pc.list_flatten(ids)), mask=ids.is_null())
    return pa.array([None if t is None else model.shown(t) for t in pc.binary_join(runs, b"").to_pylist()], pa.string())


def decode(coded: DataFrame, model: Transducer, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``decoded``, the text of their pieces; null for null."""
    keep = [c for c in (coded.columns if keep is None else keep) if c.lower() != "decoded"]
    fields = {f.name: f for f in coded.schema.fields}
    names, get = [*keep, "decoded"], share(coded, model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts_of(part.column(ids), get())], names=names)

    schema = T.StructType([*(fields[c] for c in keep), T.StructField("decoded", T.StringType())])
    return coded.mapInArrow(run, schema)
