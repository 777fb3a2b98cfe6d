"""What filters remove, alone and in every order, from the potentials of their coalitions.

In the removal game a coalition of filters is worth the documents that at least one of them removes. The
potential of Hart and Mas-Colell follows from smaller coalitions,

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|,    P(none) = 0,

and a filter's Shapley value is P(all) - P(all without it). Everything else is a difference of
coalitions: a step removes v(before and it) - v(before). With five filters there are 32 coalitions, and
120 times a potential is a whole number, the sum over all orders.

Each document becomes one narrow row: its part and which filters it fails. The first id of a text is
found by a hash of the whole text; documents are joined with the texts that occur twice, a join that Spark
divides where a text is very common. Rows are then counted by part and failures, map-side first, and
only those counts, at most 32 times 4 a part, make up coalitions.

A null text is empty. A null source is the part of the empty name. A document with a null id is no
earlier copy and fails no copy test; rows of one id are not copies of each other. Labels of one id count
together: good or toxic if any of them says so; documents without a label are neither. Very long texts
are read in place. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Conditions of the filters that look at one text. ``text`` is not null."""
    words = F.array_remove(F.split(text, WHITE), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def with_failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, failed: a bit for each filter, the first one's lowest."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in failures(whole).items()), F.lit(0))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("failed"),
        F.unhex(F.sha2(whole, 256)).alias("hash"),
    )
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").drop("n")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(firsts, "hash", "left").select("doc_id", "part", (F.col("failed") + copy).alias("failed"))


def cells(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, failed, docs, good, toxic: counts of documents."""
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = failed.join(known, "doc_id", "left")
    return joined.groupBy("part", "failed").agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def coalitions(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row for each part: total, and arrays by coalition (bits of its filters) of the documents it removes,
    removed, removed_good, removed_toxic."""
    def worth(measure: str) -> Column:
        hit = [F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(measure)).otherwise(0)) for s in range(1 << filters)]
        return F.array(*hit)

    return counted.groupBy("part").agg(
        F.sum("docs").alias("total"), worth("docs").alias("removed"), worth("good").alias("removed_good"), worth("toxic").alias("removed_toxic")
    )


def with_potentials(games: DataFrame, filters: int = len(FILTERS), scale: int = 120) -> DataFrame:
    """Add ``potential``: by coalition, ``scale`` times P. One projection for each size of coalition."""
    kept, everything = games.columns, range(1 << filters)
    made = games.withColumn("_p0", F.lit(0).cast("long"))
    for size in range(1, filters + 1):
        smaller = {s: [s & ~(1 << i) for i in range(filters) if s >> i & 1] for s in everything if s.bit_count() == size}
        made = made.withColumns({
            f"_p{s}": ((F.get("removed", F.lit(s)) * scale + sum(F.col(f"_p{x}") for x in subs)) / size).cast("long")
            for s, subs in smaller.items()
        })
    return made.select(*kept, F.array(*[f"_p{s}" for s in everything]).alias("potential"))


def order_steps(filters: str = FILTERS) -> Column:
    """All orders and their steps: filter_order, step, filter, before (bits), bit."""
    rows = []
    for order in permutations(filters):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << filters.index(name)
            rows.append({"filter_order": "".join(order), "step": k + 1, "filter": name, "before": before, "bit": bit})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,filter:string,before:int,bit:int>>")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order and step."""
    games = with_potentials(coalitions(cells(with_failures(docs, doc_id, text, part), labels, doc_id)))
    rows = games.withColumn("s", F.explode(order_steps())).select("*", "s.*")
    before, bit = F.col("before"), F.col("bit")
    after, all_of = before.bitwiseOR(bit), (1 << len(FILTERS)) - 1
    without = F.lit(all_of).bitwiseXOR(bit)

    def step(values: str, a: Column, b: Column) -> Column:
        return F.get(values, b) - F.get(values, a)

    removed = step("removed", before, after)
    return rows.select(
        "part", "filter_order", "step", "filter", (F.col("total") - F.get("removed", after)).alias("kept"), removed.alias("removed"),
        (F.get("removed", bit) - removed).alias("redundant"), step("removed", without, F.lit(all_of)).alias("unique_fails"),
        step("removed_good", before, after).alias("good_lost"), step("removed_toxic", before, after).alias("toxic_lost"),
        step("potential", without, F.lit(all_of)).alias("shapley"),
    )
