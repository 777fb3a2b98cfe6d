import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering as O
from millrace.options import SplitOptions


def key(i, seed=42):
    return hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n, sizes", [(10_007, (9006, 500, 501)), (0, (0, 0, 0)), (1, (0, 0, 1)), (19, (17, 0, 2)), (20, (18, 1, 1))])
def test_split_sizes_and_members(spark, n, sizes):
    done = O.exact_split(spark.range(n), "id").collect()
    order = sorted(range(n), key=key)
    train, validation = sizes[0], sizes[0] + sizes[1]
    want = {i: "train" if at < train else "validation" if at < validation else "test" for at, i in enumerate(order)}
    assert {r.id: r.split for r in done} == want
    counts = O.split_counts(O.exact_split(spark.range(n), "id")).first()
    assert (counts.train_samples, counts.validation_samples, counts.test_samples) == sizes
    bounds = O.split_bounds(spark.range(n).select(O.order_key(42, "id").alias("k")), "k").first()
    assert (bounds.total_samples, bounds.train_samples, bounds.validation_samples, bounds.test_samples) == (n, *sizes)


def test_nothing_left_for_test(spark):
    options = SplitOptions(train=0.5, validation=0.5)
    counts = O.split_counts(O.exact_split(spark.range(10), "id", options=options)).first()
    assert (counts.train_samples, counts.validation_samples, counts.test_samples) == (5, 5, 0)
    bounds = O.split_bounds(spark.range(10).select(O.order_key(42, "id").alias("k")), "k", options).first()
    assert (bounds.train_samples, bounds.validation_samples, bounds.test_samples) == (5, 5, 0)


def test_split_does_not_depend_on_partitions(spark):
    one = {r.id: r.split for r in O.exact_split(spark.range(500).repartition(1), "id").collect()}
    many = {r.id: r.split for r in O.exact_split(spark.range(500).repartition(13), "id").collect()}
    assert one == many


def test_copies_stay_together(spark):
    hot = spark.range(900).select((F.col("id") % 600 * F.when(F.col("id") < 300, 0).otherwise(1)).alias("id"))
    done = O.exact_split(hot, "id").groupBy("id").agg(F.countDistinct("split").alias("n"))
    assert done.filter("n > 1").isEmpty()
    bounds = O.split_bounds(hot.select(O.order_key(42, "id").alias("k")), "k").first()
    counts = O.split_counts(O.exact_split(hot, "id")).first()
    assert (bounds.train_samples, bounds.validation_samples, bounds.test_samples) == (
        counts.train_samples, counts.validation_samples, counts.test_samples)


def test_rank_and_shuffle_agree(spark):
    ranks = {r.id: r["rank"] for r in O.global_rank(spark.range(3000), "id").collect()}
    order = sorted(range(3000), key=key)
    assert [ranks[i] for i in order] == list(range(3000))
    assert [r.id for r in O.shuffle(spark.range(3000), "id", partitions=7).collect()] == order


def test_no_window_without_a_key_over_the_data(spark):
    """Only bucket counts may meet in one partition, and labelling moves no row."""
    keyed = spark.range(1000).select(O.order_key(42, "id").alias("k"))
    plan = O.split_bounds(keyed, "k")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("size#" in line or "[bucket#" in line for line in windows)
    labels = O.exact_split(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in labels and "Window" not in labels
