import pytest
from pyspark.sql import functions as F

from millrace.operators import files as FI
from millrace.operators import merge as M
from millrace.operators import ordering as O
from millrace.operators import samples as S
from millrace.session import work_path
from millrace.streaming import live as L

SCHEMA = "repo string, rel_path string, language string, content string"
BODY = "\n".join(f"word_{n} = {n}" for n in range(30))


def slices():
    first = [("r", f"{i}.py", "python", f"# {i}\n{BODY}") for i in range(6)]
    second = [("r", f"copy/{i}.py", "python", f"# {i}\n{BODY}") for i in range(3)] + [("s", "0.py", "python", f"# 0\n{BODY}")]
    third = [("r", f"{i}.py", "python", f"# {i}\n{BODY}") for i in range(6, 9)] + [("r", "z.py", "python", f"# 7\n{BODY}")]
    return [first, second, third]


@pytest.fixture
def arriving(spark):
    path = work_path(spark, "arriving")
    for part in slices():
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def everything(spark):
    return spark.createDataFrame([row for part in slices() for row in part], SCHEMA)


def run(writer):
    query = writer.start()
    query.awaitTermination()
    assert query.exception() is None


def test_stream_ingest_equals_batch_and_can_be_repeated(spark, arriving):
    store, log = work_path(spark, "store"), work_path(spark, "log")
    files = arriving().drop("language")
    run(L.stream_ingest(files, store, log))
    stored = spark.read.schema(L.STREAM_FILES).parquet(store)
    batch = FI.dedupe_content(FI.scan_files(everything(spark).drop("language")))
    keys = lambda df: sorted((r.repo, r.content_hash) for r in df.select("repo", "content_hash").collect())
    assert keys(stored) == keys(batch)
    assert stored.select("batch_id").distinct().count() == 3
    run(L.stream_ingest(files, store, log))
    assert keys(spark.read.schema(L.STREAM_FILES).parquet(store)) == keys(batch)
    run(L.stream_ingest(files, store, work_path(spark, "log")))  # every batch again, as after a lost log
    assert keys(spark.read.schema(L.STREAM_FILES).parquet(store)) == keys(batch)


def test_stream_state_equals_batch(spark, arriving):
    out, log = work_path(spark, "out"), work_path(spark, "log")
    kept = L.stream_dedupe_state(arriving().drop("language")).select("repo", "content_hash")
    run(kept.writeStream.format("parquet").option("checkpointLocation", log).option("path", out).trigger(availableNow=True))
    batch = FI.dedupe_content(FI.scan_files(everything(spark).drop("language")))
    assert spark.read.parquet(out).count() == batch.count() == spark.read.parquet(out).distinct().count()


def test_bounded_state_runs(spark, arriving):
    out, log = work_path(spark, "out"), work_path(spark, "log")
    timed = arriving().drop("language").withColumn("seen_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    kept = L.stream_dedupe_state(timed, arrival="seen_at", within="1 hour").select("repo", "content_hash")
    run(kept.writeStream.format("parquet").option("checkpointLocation", log).option("path", out).trigger(availableNow=True))
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 10


def test_stream_build_adds_only_new_samples(spark, arriving):
    output, log = work_path(spark, "grow"), work_path(spark, "log")
    run(L.stream_dataset_build(arriving(), output, log))
    versions = L.list_versions(spark, output).orderBy("batch_id").collect()
    assert [v.batch_id for v in versions] == [0, 1, 2]
    assert sum(v.new_samples for v in versions) == versions[-1].total_samples

    merged = None
    for part in slices():
        made = S.build_samples(spark.createDataFrame(part, SCHEMA))
        merged = made if merged is None else M.union_incremental(made, merged)
    want = {r.id: r.split for r in O.exact_split(merged, "id", "text").collect()}
    assert {r.id: r.split for r in L.read_version(spark, output).collect()} == want
    assert L.read_version(spark, output, 0).count() == versions[0].total_samples
    run(L.stream_dataset_build(arriving(), output, work_path(spark, "log")))
    assert {r.id: r.split for r in L.read_version(spark, output).collect()} == want
