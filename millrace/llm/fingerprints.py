"""Document fingerprints by consistent weighted sampling, in SQL functions only.

Terms are lower-cased words, weighted by how often a text has them. For each term and each of
``samples`` draws, hashes of both give r and c, gamma distributed with shape 2, and b, uniform. With
weight w, t = floor(ln w / r + b) and a = c / exp(r (t - b + 1)); the draw's sample is the term and t of
the least a. Two texts share a sample with the probability of their generalised Jaccard similarity,
sum of least weights by sum of greatest, so the share of equal samples estimates it.

ln a, to 2**-23, and 32 bits of a hash of the sample make up one number, of which each draw takes the
minimum; equal numbers are equal samples. A term that a text and its edited one have equally often is drawn once
for both.

Each text is also compared with an edited one, whose last quarter is taken from the beginning of the
next document by id. Documents are dealt to ranges of ids with equal numbers of rows; a range also
gets the first document of the following one. Whole texts are shuffled once, and the rest is done
where they are: neighbours, terms, samples.

A null text counts as empty; an empty text has no samples and equals other such texts only. A document
with a null id has no place in the order, and the empty text for its next. Rows of one id follow one
another in order of their texts. The last document is followed by the first. Empty tables give no
rows. Only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
RANGES_A_TASK = 4  # ranges for each shuffle partition
WHITE = r"[\x20\x09-\x0D]+"
_NONE = -1  # the draw of a text without terms
_STEP = 0x5BD1E995  # odd, below 2**31
OWN, EDITED, BOTH = 1, 2, 3


def _uniform(bits: Column, width: int) -> Column:
    """From 0 to 1, both excluded."""
    return (bits.cast("double") + 0.5) / float(1 << width)


def draw(term: Column, log_weight: Column, k: int) -> Column:
    """ln a and the sample's hash as one number."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    low21, low22, low32 = F.lit((1 << 21) - 1), F.lit((1 << 22) - 1), F.lit((1 << 32) - 1)
    r = -F.ln(_uniform(F.shiftrightunsigned(one, 43), 21) * _uniform(F.shiftrightunsigned(one, 22).bitwiseAND(low21), 21))
    b = _uniform(one.bitwiseAND(low22), 22)
    c = -F.ln(_uniform(F.shiftrightunsigned(two, 32), 32) * _uniform(two.bitwiseAND(low32), 32))
    t = F.floor(log_weight / r + b)
    log_a = F.ln(c) - r * (t - b + 1.0)
    rank = F.floor((log_a + 128.0) * float(1 << 23)).cast("long")
    name = one.bitwiseXOR(t * F.lit(_STEP))  # an odd step: other t, other name
    return F.shiftleft(rank, 32).bitwiseOR(name.bitwiseAND(low32))


def with_terms(df: DataFrame, own: str, edited: str) -> DataFrame:
    """One row for each term of the two texts and its weight: term (hash), log_weight and side, which says whose
    it is. A term that both texts have equally often is one row of both; no terms at all: one row with nulls.

    The lowest bit of a hash says which text it is from, so that in the sorted hashes the copies of a term in one
    text lie together, beside those in the other."""
    def hashes(name: str, bit: int) -> Column:
        words = F.array_remove(F.split(F.lower(F.col(name)), WHITE), "")
        return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))

    kept = [c for c in df.columns if c not in (own, edited)]
    sorted_ = df.select(*kept, F.sort_array(F.concat(hashes(own, 0), hashes(edited, 1))).alias("_terms"))
    n = F.size("_terms")
    begins = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1))),
    )
    cut = sorted_.select(*kept, "_terms", begins.alias("_begins"))
    rows = cut.select(*kept, "_terms", "_begins", F.posexplode_outer("_begins").alias("_i", "_begin"))

    def begin(step: int) -> Column:
        return F.get("_begins", F.col("_i") + step)

    def term(at: Column) -> Column:
        return F.shiftright(F.get("_terms", at), 1)

    here, count = F.col("_begin"), F.coalesce(begin(1), n) - F.col("_begin")
    as_before = (term(begin(-1)) == term(here)) & (here - begin(-1) == count)
    as_after = (term(begin(1)) == term(here)) & (F.coalesce(begin(2), n) - begin(1) == count)
    side = F.when(F.coalesce(as_after, F.lit(False)), BOTH).when(F.get("_terms", here).bitwiseAND(F.lit(1)) == 0, OWN).otherwise(EDITED)
    return rows.filter(~F.coalesce(as_before, F.lit(False))).select(
        *kept, term(here).alias("term"), F.ln(count.cast("double")).alias("log_weight"), F.when(here.isNotNull(), side).alias("side")
    )


def range_bounds(docs: DataFrame, doc_id: str, ranges: int) -> list:
    """Ids that begin the ranges but the first, about equally many rows in each."""
    if ranges < 2:
        return []
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    row = docs.agg(F.percentile_approx(doc_id, at, F.lit(max(10_000, 20 * ranges))).alias("b")).first()
    return sorted(set(row["b"] or ()))


def range_of(doc_id: Column, bounds: list) -> Column:
    """How many bounds are not above the id: first among every root-th bound, then behind that."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    ids = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    passed = F.size(F.filter(coarse, lambda b: b <= doc_id)) * step
    return passed + F.size(F.filter(F.slice(ids, passed + 1, step), lambda b: b <= doc_id))


def with_next(docs: DataFrame, doc_id: str, text: str, ranges: int) -> DataFrame:
    """range, place, doc_id, text, next_text, extra: rows of a range in order; extra rows stand at its
    end as the next of its last row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", ranges)
    alone = -1 - F.pmod(F.xxhash64("text"), F.lit(ranges)).cast("int")
    dealt = rows.withColumn("range", F.when(F.col("doc_id").isNull(), alone).otherwise(range_of(F.col("doc_id"), bounds)))
    known = rows.filter("doc_id IS NOT NULL").select(range_of(F.col("doc_id"), bounds).alias("r"), "doc_id")
    firsts = known.groupBy("r").agg(F.min("doc_id").alias("first"))
    following = F.coalesce(F.lead("first").over(Window.orderBy("r")), F.min("first").over(Window.partitionBy()))
    ends = firsts.select(F.col("r").alias("range"), following.alias("doc_id"))  # one row for each range, so at most ``ranges``
    extra = rows.join(F.broadcast(ends), "doc_id").select("doc_id", "text", "range", F.lit(True).alias("extra"))
    both = dealt.select("doc_id", "text", F.col("range").cast("int"), F.lit(False).alias("extra")).unionByName(extra)
    order = Window.partitionBy("range").orderBy("extra", "doc_id", "text")
    placed = both.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    return placed.withColumn("next_text", F.when(F.col("range") < 0, "").otherwise(F.coalesce("next_text", F.lit(""))))


def _signature(columns: list[str]) -> Column:
    """Eight hex digits for each draw."""
    low = F.lit((1 << 32) - 1)
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(c).bitwiseAND(low))), 8, "0") for c in columns])


def _likeness(a: list[Column], b: list[Column]) -> Column:
    return sum(((x == y).cast("int") for x, y in zip(a, b)), F.lit(0)) / float(len(a))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ranges = RANGES_A_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    paired = with_next(docs, doc_id, text, ranges).select(
        "range", "place", "doc_id", "extra", F.length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"),
    )
    keys = ["range", "place", "doc_id", "extra", "n_chars", "edited_sha256"]
    terms = with_terms(paired.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, "text", "edited"), "text", "edited")
    own, edited = [f"s{k}" for k in range(samples)], [f"e{k}" for k in range(samples)]
    # plain minima: Spark shares the parts of a draw, which it does not do inside a condition
    each = terms.groupBy(*keys, "side").agg(*[F.min(draw(F.col("term"), F.col("log_weight"), k)).alias(f"d{k}") for k in range(samples)])
    drawn = each.groupBy(*keys).agg(
        *[F.coalesce(F.min(F.when(F.col("side") != EDITED, F.col(f"d{k}"))), F.lit(_NONE)).alias(c) for k, c in enumerate(own)],
        *[F.coalesce(F.min(F.when(F.col("side") != OWN, F.col(f"d{k}"))), F.lit(_NONE)).alias(c) for k, c in enumerate(edited)],
    )
    following = F.lead(F.array(*own)).over(Window.partitionBy("range").orderBy("place"))
    made = drawn.withColumn("next", F.when(F.col("range") >= 0, following)).filter(~F.col("extra"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", _signature(own).alias("fingerprint"), _signature(edited).alias("edited_fingerprint"),
        _likeness([F.col(c) for c in own], [F.col(c) for c in edited]).alias("near_edited"),
        _likeness([F.col(c) for c in own], [F.coalesce(F.get("next", F.lit(k)), F.lit(_NONE)) for k in range(samples)]).alias("near_next"),
    )
