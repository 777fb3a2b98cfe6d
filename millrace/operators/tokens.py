"""Word-level vocabulary, tokenization, token statistics and padded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.constants import IGNORED_LABEL, PROMPT_MAX_TOKENS
from millrace.functions.text import WORD, WS
from millrace.operators.ordering import global_rank
from millrace.options import TokenOptions
from millrace.session import stage

UNKNOWN_ID = 0
END_ID = 1  # also pads
FIRST_WORD_ID = 2
PIECE = f"[{WORD}]++|[^{WORD}{WS}]"
MAX_VOCABULARY = 1_000_000
MAX_VOCABULARY_BYTES = 64 * 1024 * 1024
PART_SIZE = 1 << 20


def pieces(text: Column) -> Column:
    """Words and single other visible characters, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def build_vocabulary(docs: DataFrame, text: str = "text", size: int = TokenOptions.vocabulary_size) -> DataFrame:
    """The ``size`` most frequent pieces (ties: smaller text first) as token, n, token_id.

    Counting combines on the map side, so a piece making up much of the corpus is no hot spot.
    The counts are stored once. A histogram over powers of two (at most 64 rows) then gives a
    count that at least ``size`` pieces reach, and only pieces reaching it are ranked; otherwise
    every partition would send its own ``size`` best rows to one task.
    """
    if not 0 < size <= MAX_VOCABULARY:
        raise ValueError(f"size must be between 1 and {MAX_VOCABULARY}")
    found = docs.select(F.explode(pieces(F.col(text))).alias("token"))
    counted = stage(found.groupBy("token").agg(F.count("*").alias("n")), "token-counts")
    order = [F.desc("n"), F.asc("token")]
    top = counted.filter(F.col("n") >= _count_reached(counted, size)).orderBy(*order).limit(size)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("token_id", (rank + (FIRST_WORD_ID - 1)).cast("int"))


def _count_reached(counted: DataFrame, size: int) -> int:
    """The largest power of two that at least ``size`` pieces reach, or 1."""
    digits = F.length(F.bin("n"))
    bins = {row.digits: row["count"] for row in counted.groupBy(digits.alias("digits")).count().collect()}
    seen = 0
    for digits in sorted(bins, reverse=True):
        seen += bins[digits]
        if seen >= size:
            return 2 ** (digits - 1)
    return 1


def map_batches(
    df: DataFrame, function: Callable, schema: T.StructType | str, columns: list[str] | None = None
) -> DataFrame:
    """Apply ``function(pandas frame) -> pandas frame`` to batches in parallel. Give ``columns``
    to leave the others behind before they are sent to Python.

    A batch goes in parts of about a million characters or list elements, or of one row, so that what a function makes of
    each is bounded: ids as Python lists take eight times the bytes of their text or more."""
    limit = PART_SIZE

    def parts(batch):
        import numpy as np

        sizes = np.ones(len(batch), np.int64)
        for name in batch.columns[batch.dtypes == object]:
            sizes += np.fromiter((len(v) if hasattr(v, "__len__") else 0 for v in batch[name]), np.int64, len(batch))
        ends = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.iloc[at:end].reset_index(drop=True)
            at = end

    def run(batches: Iterator):
        for batch in batches:
            for part in parts(batch) if len(batch) else [batch]:
                yield function(part)

    return (df.select(*columns) if columns else df).mapInPandas(run, schema)


def _lookup(vocabulary: Broadcast) -> Callable:
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = vocabulary.value
        for batch in batches:
            last = batch.num_columns - 1
            lists = batch.column(last)
            words = lists.flatten().cast(pa.string()).dictionary_encode()
            ids = np.fromiter((known.get(w, 0) for w in words.dictionary.to_pylist()), np.int32, len(words.dictionary))
            counts = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
            ends = pc.cumulative_sum(counts).cast(pa.int32())
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            out = pa.ListArray.from_arrays(offsets, pa.array(ids).take(words.indices))
            names = [*batch.schema.names[:last], "input_ids"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], out], names=names)

    return run


def fits(vocabulary: DataFrame) -> bool:
    """Whether a vocabulary is small enough to be handed to every executor."""
    size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("b")).first()
    return size.n <= MAX_VOCABULARY and size.b <= MAX_VOCABULARY_BYTES


def share_vocabulary(vocabulary: DataFrame) -> Broadcast | DataFrame:
    """Hand (token, token_id) to every executor; a vocabulary over the limits stays a table, which
    token_ids joins."""
    if not fits(vocabulary):
        return vocabulary
    rows = vocabulary.select("token", "token_id").collect()
    return vocabulary.sparkSession.sparkContext.broadcast({row.token: row.token_id for row in rows})


def _joined_ids(docs: DataFrame, vocabulary: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """Ids by a join, for vocabularies of any size."""
    cut = docs.select(*keep, tokens.alias("_tokens")).withColumn("_row", F.monotonically_increasing_id())
    rows = stage(cut, "tokens")
    each = rows.select("_row", F.posexplode("_tokens").alias("_at", "token"))
    found = each.join(vocabulary.select("token", "token_id"), "token", "left")
    place = F.struct("_at", F.coalesce("token_id", F.lit(UNKNOWN_ID)).cast("int").alias("id"))
    ids = found.groupBy("_row").agg(F.sort_array(F.collect_list(place)).alias("_ids"))
    none = F.array().cast("array<int>")
    return rows.join(ids, "_row", "left").select(*keep, F.coalesce(F.col("_ids.id"), none).alias("input_ids"))


def token_ids(docs: DataFrame, vocabulary: DataFrame | Broadcast, keep: list[str], tokens: Column) -> DataFrame:
    """``keep`` columns and input_ids, as the vocabulary's token_id says. Spark cuts the text; a
    task looks each different token of a batch up once."""
    shared = share_vocabulary(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary
    if isinstance(shared, DataFrame):
        return _joined_ids(docs, shared, keep, tokens)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*keep, tokens.alias("tokens")).mapInArrow(_lookup(shared), schema)


def _with_mask_and_labels(ids: DataFrame) -> DataFrame:
    return ids.withColumns({
        "attention_mask": F.transform("input_ids", lambda _: F.lit(1)),
        "labels": F.col("input_ids"),
    })


def tokenize(
    docs: DataFrame, vocabulary: DataFrame | Broadcast, keep: list[str], text: str = "text",
    max_length: int = TokenOptions.max_length,
) -> DataFrame:
    """``keep`` columns and input_ids (cut to max_length, not padded), attention_mask, labels."""
    tokens = F.slice(pieces(F.col(text)), 1, max_length)
    return _with_mask_and_labels(token_ids(docs, vocabulary, keep, tokens))


def tokenize_with(
    docs: DataFrame, encode: Callable[[list[str]], list[list[int]]], keep: list[str], text: str = "text",
    max_length: int = TokenOptions.max_length,
) -> DataFrame:
    """The same with any tokenizer: ``encode`` gets a batch of texts and returns ids."""
    source = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

    def run(batch):
        encoded = [list(ids)[:max_length] for ids in encode(batch[text].tolist())]
        return batch[keep].assign(input_ids=encoded)

    return _with_mask_and_labels(map_batches(docs, run, schema, source))


def token_stats(
    docs: DataFrame, *order: str, text: str = "text", sample: int | None = TokenOptions.stats_sample
) -> DataFrame:
    """Mean, longest, shortest and total tokens over all rows, or over the first ``sample``."""
    head = docs.select(*order, text)
    if sample is not None:
        head = head.orderBy(*order).limit(sample)
    length = F.size(pieces(F.col(text))).cast("long")
    return head.select(length.alias("tokens")).agg(
        F.avg("tokens").alias("mean"),
        F.max("tokens").alias("max"),
        F.min("tokens").alias("min"),
        F.sum("tokens").alias("total_tokens"),
        F.count("*").alias("samples"),
    )


def truncate_prompt(tokens: Column, limit: int = PROMPT_MAX_TOKENS) -> Column:
    return F.slice(tokens, 1, limit)


def pad_batches(
    tokenized: DataFrame, *id_columns: str, batch_size: int = TokenOptions.batch_size, seed: int = 42,
    pad_id: int = END_ID,
) -> DataFrame:
    """Batches in the seeded order, padded to their longest row; padding is masked and ignored.

    Ranks and the longest row of a batch are found on ids and sizes; the token arrays are written
    once and moved once, to meet their places.
    """
    rows = stage(tokenized.withColumn("_row", F.monotonically_increasing_id()), "rows")
    narrow = rows.select(*id_columns, "_row", F.size("input_ids").alias("_size"))
    batched = global_rank(narrow, *id_columns, seed=seed).select(
        "_row", F.floor(F.col("rank") / batch_size).alias("batch_id"), (F.col("rank") % batch_size).cast("int").alias("slot"), "_size")
    longest = F.max("_size").over(Window.partitionBy("batch_id"))
    places = batched.withColumn("_gap", longest - F.col("_size")).drop("_size")
    padded = rows.join(places, "_row").drop("_row")

    def filled(column: str, value: int) -> Column:
        return F.concat(F.col(column), F.array_repeat(F.lit(value), F.col("_gap")))

    return padded.withColumns({
        "input_ids": filled("input_ids", pad_id),
        "attention_mask": filled("attention_mask", 0),
        "labels": filled("labels", IGNORED_LABEL),
    }).drop("_gap")
