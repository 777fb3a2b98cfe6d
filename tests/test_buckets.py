"""Tables in buckets, bucketed merge keys, and metrics of any shape."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog as K
from millrace.operators import merge as M
from millrace.session import list_directories, work_path
from millrace.sources.buckets import BucketedTable


def results(spark, *rows):
    return spark.createDataFrame(rows, "url string, name string, branch string, files long, lines long, size_kb double, local_path string, error string")


def test_one_repository_writes_one_bucket(spark):
    table = BucketedTable(spark, work_path(spark, "cat"), "repositories", "url", buckets=16)
    assert table.read().count() == 0 and table.merge(results(spark), K.upsert_repositories) == []
    first = results(spark, *[(f"u{i}", f"n{i}", "main", i, 1, 1.0, "p", None) for i in range(60)])
    assert len(table.merge(first, K.upsert_repositories)) > 10
    before = table.folders()
    assert len(table.merge(results(spark, ("u7", "n7", "main", 70, 2, 2.0, "q", None)), K.upsert_repositories)) == 1
    after = table.folders()
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r.url: r.files_count for r in table.read().collect()}
    assert got == {f"u{i}": 70 if i == 7 else i for i in range(60)}
    assert {r.url: r.files_count for r in table.read(table.snapshots()[-2]).collect()}["u7"] == 7
    table.merge(results(spark, ("u7", "n7", "main", 0, 0, 0.0, "q", "gone"), ("new", "n", "main", 1, 1, 1.0, "p", None)), K.upsert_repositories)
    rows = {r.url: r for r in table.read().collect()}
    assert len(rows) == 61 and (rows["u7"].status, rows["u7"].files_count, rows["u7"].error_message) == ("failed", 70, "gone")


def test_a_failed_merge_changes_nothing(spark):
    table = BucketedTable(spark, work_path(spark, "cat"), "repositories", "url", buckets=4)
    table.merge(results(spark, ("u", "n", "main", 1, 1, 1.0, "p", None)), K.upsert_repositories)
    fails = lambda old, new: K.upsert_repositories(old, new).withColumn("name", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        table.merge(results(spark, ("u", "n", "main", 2, 1, 1.0, "p", None)), fails)
    assert [r.files_count for r in table.read().collect()] == [1] and len(list_directories(spark, table.path)) >= 2
    table.merge(results(spark, ("u", "n", "main", 3, 1, 1.0, "p", None)), K.upsert_repositories)
    assert [r.files_count for r in table.read().collect()] == [3]


def test_stored_keys_are_not_shuffled(spark):
    old = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    new = spark.range(2000, 5000).select(F.concat(F.lit("text "), (F.col("id") % 4000).cast("string")).alias("text"))
    keys = M.store_keys(old, "stored_keys_test", buckets=8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = M.without_known(new, keys, M.merge_key())
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(_key" not in plan
        assert sorted(r.text for r in made.collect()) == sorted(r.text for r in M.incremental_anti_join(new, old).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_keys_test")


def test_metrics_of_any_shape(spark):
    rows = [(1, '{"a": 1, "b": {"c": 2.5, "d": [3, "4", true]}, "o\'k": 7}'), (2, '{"a": "1e3", "b": "text"}'), (3, "{"), (4, None), (5, "[1]"), (6, '{"a": true, "b": null}')]
    runs = spark.createDataFrame(rows, "id int, metrics string")
    names = ("a", "b.c", "b.d[0]", "b.d[1]", "b.d[2]", "o'k", "z")
    got = {r[0]: tuple(r)[1:] for r in runs.select("id", *K.metric_columns(*names)).collect()}
    none = (None,) * 7
    assert got == {1: (1.0, 2.5, 3.0, 4.0, None, 7.0, None), 2: (1000.0, *none[1:]), 3: none, 4: none, 5: none, 6: none}
    shown = dict(runs.select("id", *K.metric_texts("b")).collect())
    assert shown[2] == "text" and shown[3] is None
    schema = K.metrics_schema(runs.filter("id = 1")).first().schema
    assert "c: DECIMAL" in schema and schema.startswith("OBJECT<")
