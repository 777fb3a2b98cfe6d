"""Repeatable shuffling, exact splits and gap-free ranks, without a one-task window over the data.

Rows are ordered by a SHA-256 of (seed, id columns), which is uniform whatever the ids are. The
first four hex digits name one of 65,536 buckets. Counting rows per bucket is a partial
aggregation; only these at most 65,536 counts ever meet in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.options import SplitOptions

BUCKET_DIGITS = 4
BUCKETS = 16**BUCKET_DIGITS
ABOVE_ALL_KEYS = "g"  # hex keys sort below it


def order_key(seed: int, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *columns), 256)


def _bucket(key: str) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def bucket_sizes(keyed: DataFrame, key: str) -> DataFrame:
    """bucket, size: at most 65,536 rows. Sizes of several tables add up to those of their union."""
    return keyed.groupBy(_bucket(key).alias("bucket")).agg(F.count("*").alias("size"))


def add_sizes(*sizes: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, sizes)
    return both.groupBy("bucket").agg(F.sum("size").alias("size"))


def _offsets(sizes: DataFrame) -> DataFrame:
    """bucket, size, first (rows in earlier buckets), n (all rows): one row per bucket."""
    return sizes.withColumns({
        "first": F.sum("size").over(Window.orderBy("bucket")) - F.col("size"),
        "n": F.sum("size").over(Window.partitionBy()),
    })


def _bucket_offsets(keyed: DataFrame, key: str) -> DataFrame:
    return _offsets(bucket_sizes(keyed, key))


def split_sizes(n: Column, options: SplitOptions = SplitOptions()) -> dict[str, Column]:
    """Whole-number sizes, cut in binary floating point."""
    n = n.cast("double")
    train = F.floor(n * F.lit(float(options.train)))
    validation = F.floor(n * F.lit(float(options.validation)))
    return {"train": train, "validation": validation}


def _inside(at: str, first: str, size: str) -> Column:
    return (F.col(first) <= F.col(at)) & (F.col(at) < F.col(first) + F.col(size))


def split_edges(sizes: DataFrame, options: SplitOptions = SplitOptions()) -> DataFrame:
    """The buckets, three at most, in which a split may begin: bucket, first, n, validation_at, test_at."""
    counts = split_sizes(F.col("n"), options)
    offsets = _offsets(sizes).withColumns({
        "validation_at": counts["train"],
        "test_at": counts["train"] + counts["validation"],
    })
    # an empty split has its bound behind the last row; the last bucket then stands in for it
    last = F.col("first") + F.col("size") == F.col("n")
    edges = offsets.filter(_inside("validation_at", "first", "size") | _inside("test_at", "first", "size") | last)
    return edges.drop("size")


def in_buckets(key: str, buckets: list[str]) -> Column:
    """Whether a key lies in one of the buckets, as ranges that reach a sorted scan."""
    ranges = [(F.col(key) >= b) & (F.col(key) < b + ABOVE_ALL_KEYS) for b in buckets]
    return reduce(or_, ranges, F.lit(False))


def split_bounds(keyed: DataFrame, key: str, options: SplitOptions = SplitOptions()) -> DataFrame:
    """One row: validation_from and test_from, the keys at which those splits start, and the
    rows each split gets."""
    return bounds_at(keyed, key, split_edges(bucket_sizes(keyed, key), options))


def bounds_at(keyed: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """The bounds, given the buckets that matter; ``keyed`` needs to hold the keys of these only.

    Inside them equal keys are counted together before the running sum, so copies of one id do not pile
    up in a task.
    """
    near = keyed.select(F.col(key).alias("key"), _bucket(key).alias("bucket")).join(F.broadcast(edges), "bucket")
    counted = near.groupBy(*edges.columns, "key").agg(F.count("*").alias("copies"))
    running = F.sum("copies").over(Window.partitionBy("bucket").orderBy("key"))
    placed = counted.withColumn("at", F.col("first") + running - F.col("copies"))

    def start(at: str, value: str) -> Column:
        return F.max(F.when(_inside(at, "at", "copies"), F.col(value)))

    total = F.coalesce(F.max("n"), F.lit(0))
    return placed.agg(
        F.coalesce(start("validation_at", "key"), F.lit(ABOVE_ALL_KEYS)).alias("validation_from"),
        F.coalesce(start("test_at", "key"), F.lit(ABOVE_ALL_KEYS)).alias("test_from"),
        total.alias("total_samples"),
        F.coalesce(start("validation_at", "at"), total).alias("before_validation"),
        F.coalesce(start("test_at", "at"), total).alias("before_test"),
    ).select(
        "validation_from", "test_from", "total_samples",
        F.col("before_validation").alias("train_samples"),
        (F.col("before_test") - F.col("before_validation")).alias("validation_samples"),
        (F.col("total_samples") - F.col("before_test")).alias("test_samples"),
    )


def split_label(key: Column, bounds) -> Column:
    """``bounds``: a struct column, or a collected row, with validation_from and test_from."""
    return (
        F.when(key < bounds["validation_from"], "train")
        .when(key < bounds["test_from"], "validation")
        .otherwise("test")
    )


def exact_split(
    df: DataFrame, *id_columns: str, options: SplitOptions = SplitOptions(), key: str | None = None
) -> DataFrame:
    """Add ``split``. Sizes are exact when the id columns identify a row; copies of one id are
    never torn apart. Rows are not shuffled: a first job finds two bounds (one row reaches the
    driver), then every row is compared with two constants.

    ``key`` names a column that already holds the order key. The input is read twice for the
    bounds and once for the rows; give a stored table (session.stage) when it is costly.
    """
    keyed = df if key else df.withColumn("_key", order_key(options.seed, *id_columns))
    name = key or "_key"
    bounds = split_bounds(keyed.select(name), name, options).first()
    labelled = keyed.withColumn("split", split_label(F.col(name), bounds))
    return labelled if key else labelled.drop("_key")


def split_counts(split: DataFrame) -> DataFrame:
    return split.agg(
        F.count("*").alias("total_samples"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in ("train", "validation", "test")],
    )


def key_share(key: str, n: int) -> Column:
    """Which of n equal ranges of keys a key lies in."""
    return F.floor(F.conv(_bucket(key), 16, 10).cast("int") * F.lit(n) / F.lit(BUCKETS)).cast("int")


def shuffle(df: DataFrame, *id_columns: str, seed: int = 42, partitions: int | None = None,
            key: str | None = None) -> DataFrame:
    """A seeded random order. The keys are uniform, so ranges of buckets are equal shares and
    no sampling pass is needed to find range bounds."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df if key else df.withColumn("_key", order_key(seed, *id_columns))
    name = key or "_key"
    ordered = keyed.repartitionById(n, key_share(name, n)).sortWithinPartitions(name)
    return ordered if key else ordered.drop("_key")


def global_rank(df: DataFrame, *id_columns: str, seed: int = 42) -> DataFrame:
    """Add ``rank``, 0-based and without gaps, in the seeded order."""
    keyed = df.withColumn("_key", order_key(seed, *id_columns)).withColumn("_bucket", _bucket("_key"))
    offsets = _bucket_offsets(keyed.select("_key"), "_key").select(
        F.col("bucket").alias("_bucket"), "first"
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    ranked = keyed.withColumn("_at", inside).join(F.broadcast(offsets), "_bucket")
    return ranked.withColumn("rank", F.col("first") + F.col("_at") - 1).drop("_key", "_bucket", "_at", "first")
