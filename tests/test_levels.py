"""Levelled keys, bounds from summaries, and first copies by session."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.operators import files as FI
from millrace.operators import ordering as O
from millrace.session import list_directories, path_exists, work_path
from millrace.streaming import live as L
from millrace.sources.levels import KeyLevels, covering
from tests.test_streaming import BODY, SCHEMA, run


def key(*parts):
    return hashlib.sha256(repr(parts).encode()).hexdigest()


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_covering_runs(fan):
    for n in range(200):
        runs = covering(n, fan)
        assert [b for first, last in runs for b in range(first, last + 1)] == list(range(n))
        sizes = [last - first + 1 for first, last in runs]
        assert sizes == sorted(sizes, reverse=True) and all(sizes.count(s) < fan for s in sizes)


def test_levels_keep_few_runs_and_can_be_repeated(spark):
    store = KeyLevels(spark, work_path(spark, "keys"), fan=3, keys_per_file=4)
    def batch(i):
        return spark.createDataFrame([("a", key(i, k)) for k in range(5)] + [("b", key("b", i))], "kind string, key string")
    def stored(before, kind):
        return sorted(r.key for r in store.read(before, kind).collect())
    for i in range(10):
        assert stored(i, "a") == sorted(key(j, k) for j in range(i) for k in range(5))
        store.sweep(i)
        for _ in range(2):  # as after a failure
            store.add(i, batch(i), 6)
            assert stored(i, "b") == sorted(key("b", j) for j in range(i))
        runs = {p.rsplit("/", 1)[-1] for p, _ in list_directories(spark, store.path)}
        assert {f"run-{a}-{b}" for a, b in covering(i + 1, 3)} <= runs and len(runs) <= 2 * 3 * 3
    assert not path_exists(spark, store.folder(0, 0)) and path_exists(spark, store.folder(0, 8))


def test_range_of_keys_reaches_the_scan(spark):
    store = KeyLevels(spark, work_path(spark, "keys"))
    store.add(0, spark.createDataFrame([("a", key(k)) for k in range(100)], "kind string, key string"), 100)
    plan = store.read(1, "a").filter(O.in_buckets("key", ["0a1f"]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,0a1f)" in plan and "LessThan(key,0a1fg)" in plan


def test_bounds_from_summaries_equal_bounds_from_keys(spark):
    keyed = spark.range(5000).select(O.order_key(42, "id").alias("k"), (F.col("id") % 7).alias("batch"))
    parts = [O.bucket_sizes(keyed.filter(F.col("batch") == b), "k") for b in range(7)]
    edges = O.split_edges(O.add_sizes(*parts))
    buckets = [e.bucket for e in edges.collect()]
    near = keyed.filter(O.in_buckets("k", buckets))
    assert len(buckets) <= 3 and near.count() < 20
    assert O.bounds_at(near, "k", edges).collect() == O.split_bounds(keyed, "k").collect()


def test_stream_build_reads_no_earlier_samples(spark):
    """Eight batches: the same splits as from all samples, few runs, and summaries of a bounded size."""
    path, output = work_path(spark, "arriving"), work_path(spark, "grow")
    for i in range(8):
        rows = [("r", f"{i}/{k}.py", "python", f"# {i} {k}\n{BODY}") for k in range(4)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    run(L.stream_dataset_build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), output, work_path(spark, "log"), fan=2))
    versions = L.list_versions(spark, output).orderBy("batch_id").collect()
    assert [v.total_samples for v in versions] == [versions[0].new_samples * (i + 1) for i in range(8)]
    made = L.read_version(spark, output)
    want = {r.id: r.split for r in O.exact_split(made.drop("split"), "id", "text").collect()}
    assert {r.id: r.split for r in made.collect()} == want
    # the run of all batches, and what went into it until the next batch begins
    assert {p.rsplit("/", 1)[-1] for p, _ in list_directories(spark, f"{output}/keys")} == {
        "run-0-7", "run-0-3", "run-4-7", "run-4-5", "run-6-7", "run-6-6", "run-7-7"}
    assert spark.read.schema(L.SIZES).parquet(f"{output}/sizes/batch_id=7").agg(F.sum("size")).first()[0] == versions[-1].total_samples


def at(minute, path, content):
    return ("r", path, "python", f"# {content}\n{BODY}", minute)


def first_copies(spark, batches, within):
    path, out, log = work_path(spark, "timed"), work_path(spark, "out"), work_path(spark, "log")
    for rows in batches:
        spark.createDataFrame(rows, f"{SCHEMA}, minute long").coalesce(1).write.mode("append").parquet(path)
    files = spark.readStream.schema(f"{SCHEMA}, minute long").option("maxFilesPerTrigger", 1).parquet(path)
    timed = files.drop("language").withColumn("seen_at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("minute")))
    kept = L.stream_first_copies(timed, "seen_at", within)
    query = kept.writeStream.format("parquet").option("checkpointLocation", log).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kept.schema).parquet(out), query.recentProgress


def test_first_copies_agree_with_the_batch_and_state_shrinks(spark):
    batches = [[at(0, "b.py", "x"), at(0, "n.py", "y")], [at(5, "a.py", "x")], [at(9, "c.py", "x")], [at(1000, "z.py", "last")]]
    made, progress = first_copies(spark, batches, "10 minutes")
    rows = [r[:4] for b in batches[:3] for r in b]
    batch = FI.dedupe_content(FI.scan_files(spark.createDataFrame(rows, SCHEMA).drop("language")))
    assert made.columns == batch.columns
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, batch.collect()))
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(held) >= 2 and held[-1] == 1


def test_content_that_returns_after_its_session_is_given_out_again(spark):
    made, _ = first_copies(spark, [[at(0, "b.py", "x")], [at(60, "q.py", "y")], [at(100, "c.py", "x")], [at(1000, "z.py", "last")]], "10 minutes")
    assert sorted(r.rel_path for r in made.collect()) == ["b.py", "c.py", "q.py"]
