"""Language ID by a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of fixed length, each filter's largest
response in a window is kept, and a softmax over these names the language. The network is trained in
numpy on the driver, on a bounded sample of labelled documents: about ``per_language`` of each
language, a window from a place in the text that its hash names. Tasks apply it to all windows of
every whole text, in batches of fixed shape, and weigh the windows by their bytes.

A document is held out of training if crc32 of its id, as text, has remainder 2 modulo 4. Only text
and language of the others are learned from; id, source and language never enter a prediction. A
document with a null id is neither held out nor learned from.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing is
labelled. Each row is judged for itself, so repeated rows get equal results. Columns named like a
result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.frames import map_slices, text_bytes
from millrace.llm.words import byte_table, per_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
WIDEST = max(WIDTHS)
EMBEDDED = 8
UNKNOWN = "und"
MAX_LANGUAGES = 1000
_ASCII_LETTER = byte_table([*range(65, 91), *range(97, 123)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  #: 256 x EMBEDDED; byte 0 pads and stays zero
    filters: np.ndarray  #: (WIDEST * EMBEDDED) x all filters; rows beyond a filter's width are zero
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Every filter at every place: windows x places x filters."""
        n = windows.shape[1]
        x = np.zeros((len(windows), n + WIDEST - 1, EMBEDDED), np.float32)
        x[:, :n] = self.embed[windows]
        return np.concatenate([x[:, k : k + n] for k in range(WIDEST)], axis=2) @ self.filters

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), 16):
            hidden = self.responses(windows[i : i + 16]).max(axis=1) + self.bias
            out[i : i + 16] = softmax(np.maximum(hidden, 0) @ self.dense + self.offset)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], steps: int = 1200, batch: int = 32, rate: float = 0.004, seed: int = 7) -> Network:
    """Adam on cross entropy, each language with the same weight; some windows are cut short so that
    short texts are known too."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    width = np.repeat(WIDTHS, FILTERS)
    f = len(width)
    inside = (np.arange(WIDEST * EMBEDDED) // EMBEDDED)[:, None] < width
    net = Network(languages, normal(256, EMBEDDED) * 0.5, inside * normal(WIDEST * EMBEDDED, f) / np.sqrt(width * EMBEDDED).astype(np.float32),
                  np.zeros(f, np.float32), normal(f, len(languages)) / np.sqrt(f).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    y = np.array([languages.index(x) for x in labels])
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages))))[y].astype(np.float32)
    weights = [net.embed, net.filters, net.bias, net.dense, net.offset]
    moments, step = [(np.zeros_like(w), np.zeros_like(w)) for w in weights], 0
    epochs = -(-steps // -(-len(texts) // batch))  # the same number of steps however few the texts are
    for epoch in range(epochs):
        windows = np.zeros((len(texts), WINDOW), np.uint8)
        length = np.where(rng.random(len(texts)) < 0.5, WINDOW, rng.integers(8, WINDOW, len(texts)))
        for i, text in enumerate(texts):
            part = np.frombuffer(text[: length[i]], np.uint8)
            windows[i, : len(part)] = part
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            w = np.pad(windows[rows], ((0, 0), (0, WIDEST - 1)))
            response = net.responses(windows[rows])
            at = response.argmax(axis=1)  # rows x filters
            hidden = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + net.bias
            active = np.maximum(hidden, 0)
            p = softmax(active @ net.dense + net.offset)
            p[np.arange(len(rows)), y[rows]] -= 1
            d = p * (weight[rows, None] / len(rows))
            back = (d @ net.dense.T) * (hidden > 0)
            # only the place of a filter's largest response learns
            seen = np.take_along_axis(w[:, None, :].repeat(f, 1), at[:, :, None] + np.arange(WIDEST), 2)
            patch = net.embed[seen].reshape(len(rows), f, -1)
            filters = np.einsum("bf,bfk->kf", back, patch) * inside
            embed = np.zeros_like(net.embed)
            np.add.at(embed, seen, (back[:, :, None] * net.filters.T[None]).reshape(*seen.shape, EMBEDDED))
            embed[0] = 0
            step += 1
            for value, grad, (m, v) in zip(weights, [embed, filters, back.sum(0), active.T @ d, d.sum(0)], moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> list:
    """(text, language) of about ``per_language`` documents of each language that may be learned from."""
    id_ = F.col(doc_id)
    usable = docs.filter(id_.isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(id_), F.lit(1 << 30)) / F.lit(float(1 << 30))
    begin = F.pmod(F.xxhash64(id_, F.lit("place")), F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1)
    rows = usable.filter(chance < F.element_at(share, F.col(lang))).select(
        id_.cast("string").alias("id"), F.substr(F.col(text), begin.cast("int") + 1, F.lit(WINDOW)).alias("text"), F.col(lang).alias("lang")
    ).limit(2 * per_language * len(counts) + 100).collect()
    return [(r["text"].encode(), r["lang"]) for r in sorted(rows)]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 800) -> Network | None:
    rows = sample(docs, doc_id, text, lang, per_language)
    return train(*map(list, zip(*rows))) if rows else None


def cut_windows(data: np.ndarray, offsets: np.ndarray):
    """(windows, text of each, bytes of each)."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], size)] = data
    owner = np.repeat(np.arange(len(size)), n)
    inside = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)
    return out.reshape(-1, WINDOW), owner, inside


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = per_text(_ASCII_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~found & (per_text(data >= 128, offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def predict(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with held_out, lang_pred and score."""
    def work(batch):
        texts = batch.column(text)
        data, offsets = text_bytes(texts)
        n = len(texts)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        known = has_letter(texts, data, offsets) if net else np.zeros(n, bool)
        if net and len(data):
            windows, owner, size = cut_windows(data, offsets)
            total = np.zeros((n, len(net.languages)))
            np.add.at(total, owner, net.probabilities(windows) * size[:, None])
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best, score = total.argmax(1), np.minimum(total.max(1), 1.0)
        names = [net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))]

    results = ("held_out", "lang_pred", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    made = map_slices(docs, text, work, keep if doc_id in keep else [*keep, doc_id],
                      [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], limit=1 << 19)
    return made.select(*keep, held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score")
