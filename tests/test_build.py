import json

import pytest
from pyspark.sql import functions as F

from millrace.constants import MERGE_KEY_CHARS
from millrace.operators import catalog as K
from millrace.operators import merge as M
from millrace.operators import samples as S
from millrace.options import BuildOptions, ChunkOptions, TokenOptions
from millrace.plans import build as B
from millrace.plans import ingest as I
from millrace.plans import training as N
from millrace.operators import tokens as T
from millrace.session import path_exists, work_path
from millrace.sources import stores


def code(spark, rows):
    return spark.createDataFrame(rows, "repo string, rel_path string, language string, content string")


def text(i, words=40):
    return "\n".join(f"value_{i}_{n} = {n}" for n in range(words))


def test_preprocess_drops_small_files_and_chunks(spark):
    files = code(spark, [("r", "a.py", "python", text(1)), ("r", "b.py", "python", "x = 1"), ("r", "c.go", "go", "w " * 20)])
    options = BuildOptions(chunks=ChunkOptions(200, 50))
    rows = S.preprocess(files, options).collect()
    whole = text(1)
    expected = {i // 150: whole[i:i + 200] for i in range(0, len(whole), 150)}
    got = {r.chunk_idx: r for r in rows if r.rel_path == "a.py"}
    assert {i: r.chunk_size for i, r in got.items()} == {i: len(c) for i, c in expected.items() if i in got}
    assert all(r.text.endswith(expected[i] + "\n### End") for i, r in got.items())
    assert not [r for r in rows if r.rel_path == "b.py"]
    assert [r.token_estimate for r in rows if r.rel_path == "c.go"] == [26.0]


def test_windows_cover_the_cleaned_text(spark):
    files = code(spark, [("r", "a.py", "python", text(2, 500))])
    chunks = S.explode_chunks(files).orderBy("chunk_idx").collect()
    rebuilt = chunks[0].chunk + "".join(c.chunk[128:] for c in chunks[1:])
    assert rebuilt == text(2, 500)


def test_sample_ids_are_stable(spark):
    files = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(6)])
    once = {r.id for r in S.build_samples(files).collect()}
    again = {r.id for r in S.build_samples(files.repartition(5)).collect()}
    assert once == again and len(once) == S.build_samples(files).count()


def test_language_without_samples_counts_zero(spark):
    files = code(spark, [("r", "a.py", "python", text(1)), ("r", "b.go", "go", "x")])
    by_files = {r.language: r.samples for r in S.language_counts_from_files(files).collect()}
    by_samples = {r.language: r.samples for r in S.language_counts(S.build_samples(files), files).collect()}
    assert by_files == by_samples == {"python": 1, "go": 0}
    assert json.loads(S.languages_json(S.language_counts_from_files(files)).first().languages) == by_files


@pytest.mark.parametrize("key,kept", [("hash", ["4", "5", "6", "7"]), ("prefix", ["5", "6", "7"])])
def test_merge_compares_whole_texts_or_a_prefix(spark, key, kept):
    head = "h" * MERGE_KEY_CHARS
    existing = spark.createDataFrame([("1", head + "a"), ("2", head + "a"), ("3", "é")], "id string, text string")
    new = spark.createDataFrame([("4", head + "z"), ("5", "new"), ("6", "new"), ("7", head[:-1]), ("8", "é")], "id string, text string")
    assert sorted(r.id for r in M.incremental_anti_join(new, existing, key).collect()) == kept
    assert sorted(r.id for r in M.union_incremental(new, existing, key).collect()) == ["1", "2", "3", *kept]
    with pytest.raises(ValueError):
        M.merge_key(key="other")


def build(spark, files, existing=None):
    return B.build_dataset(files, work_path(spark, "dataset"), "v1", existing=existing)


def test_build_and_incremental_build(spark):
    files = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(30)] + [("r", "x.go", "go", "tiny")])
    first = build(spark, files)
    meta = first.metadata.first()
    assert meta.total_samples == 30 and (meta.train_samples, meta.val_samples, meta.test_samples) == (27, 1, 2)
    assert json.loads(meta.languages) == {"go": 0, "python": 30}
    counts = {r.split: r["count"] for r in first.dataset.groupBy("split").count().collect()}
    assert counts == {"train": 27, "validation": 1, "test": 2}
    row = first.version.first()
    assert row.path == meta.output_path and row.total_samples == 30

    existing = stores.read_samples_jsonl(spark, B.dataset_path(meta.output_path))
    same = build(spark, files, existing)
    assert same.metadata.first().total_samples == 30
    assert {r.id for r in same.dataset.collect()} == {r.id for r in first.dataset.collect()}

    more = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(25, 40)])
    grown = build(spark, more, existing).metadata.first()
    assert grown.total_samples == 40 and json.loads(grown.languages) == {"python": 15}


def test_build_without_new_samples_fails_even_with_existing_ones(spark):
    nothing = code(spark, [("r", "a.py", "python", "x")])
    with pytest.raises(ValueError):
        build(spark, nothing)
    existing = S.build_samples(code(spark, [("r", "b.py", "python", text(1))]))
    with pytest.raises(ValueError):
        build(spark, nothing, existing)


def test_a_changed_file_keeps_both_samples_apart(spark):
    old = S.build_samples(code(spark, [("r", "a.py", "python", text(1))]))
    changed = build(spark, code(spark, [("r", "a.py", "python", text(2))]), old)
    assert changed.dataset.count() == 2 and changed.dataset.select("id").distinct().count() == 1


def test_loading_a_version(spark):
    path = work_path(spark, "version")
    rows = spark.createDataFrame([("1", "a", "train"), ("2", "é", "train"), ("3", "b", "test")], "id string, text string, split string")
    stores.write_split_jsonl(rows, path)
    parts = stores.load_split_dataset(spark, path)
    assert {k: v.count() for k, v in parts.items()} == {"train": 2, "test": 1}
    raw = "".join(r.value for r in spark.read.text(f"{path}/split=train").collect())
    assert "é" in raw
    with pytest.raises(FileNotFoundError):
        stores.load_split_dataset(spark, work_path(spark, "nothing"))


def test_broken_lines_are_skipped_and_missing_text_is_an_error(spark):
    path = work_path(spark, "jsonl")
    spark.createDataFrame([('{"id": "1", "text": "a"}',), ("",), ("{broken",), ('{"id": "2", "text": "b"}',)], "value string").write.text(path)
    assert sorted(r.text for r in stores.read_samples_jsonl(spark, path).collect()) == ["a", "b"]
    assert stores.read_samples_jsonl(spark, path).count() == 2
    bad = work_path(spark, "jsonl")
    spark.createDataFrame([('{"id": "1"}',)], "value string").write.text(bad)
    with pytest.raises(Exception, match="sample without text"):
        stores.read_samples_jsonl(spark, bad).collect()


def test_ingest_many_repositories(spark):
    body = "a\nb\nc\nd\ne\n"
    files = spark.createDataFrame(
        [("one", "a.py", body), ("one", "b.py", body), ("one", "c.py", body + "f"), ("two", "x.go", body)],
        "repo string, rel_path string, content string")
    requests = spark.createDataFrame(
        [("https://h/o/one", "one", "main", None), ("https://h/o/two/", "two", "dev", None),
         ("https://h/o/none", "none", "main", None), ("https://h/o/bad", "bad", "main", "clone failed")],
        "url string, repo string, branch string, error string")
    first = I.ingest(requests, files, work_path(spark, "raw"))
    rows = {r.name: r for r in first.repositories.collect()}
    assert (rows["one"].status, rows["one"].files_count, rows["one"].total_lines) == ("completed", 2, 11)
    assert (rows["two"].files_count, rows["two"].branch) == (1, "dev")
    assert (rows["none"].status, rows["none"].files_count) == ("completed", 0)
    assert (rows["bad"].status, rows["bad"].error_message) == ("failed", "clone failed")
    assert first.catalog.count() == 3

    changed = spark.createDataFrame([("one", "a.py", body + "new"), ("one", "d.py", body)], files.schema)
    later = I.ingest(requests.filter("repo IN ('one', 'bad')").withColumn("error", F.lit(None).cast("string")), changed,
                     work_path(spark, "raw"), first.repositories, first.catalog)
    rows = {r.name: r for r in later.repositories.collect()}
    assert rows["one"].files_count == 2 and rows["two"].files_count == 1
    assert (rows["bad"].status, rows["bad"].error_message) == ("completed", None)
    known = {r.file_path: r.content_hash for r in first.catalog.collect()}
    catalog = {r.file_path: r.content_hash for r in later.catalog.collect()}
    assert later.catalog.count() == 4 and catalog["a.py"] == known["a.py"]


def test_repo_key_keeps_owners_apart(values):
    got = values([("https://h/a/lib",), ("https://h/b/lib",)], "u string", I.repo_key(F.col("u")))
    assert got[0] != got[1] and all(k.startswith("lib-") for k in got)


def test_training_and_finetune_inputs(spark):
    train = spark.createDataFrame([("1", "a b c"), ("2", "a a")], "id string, text string")
    vocabulary = T.build_vocabulary(train, size=2)
    made = N.training_input({"train": train, "test": train.limit(1)}, vocabulary, TokenOptions(max_length=2))
    assert set(made) == {"train", "test", "eval"}
    assert sorted(r.input_ids for r in made["train"].collect()) == [[2, 2], [2, 3]]
    assert made["eval"].count() == 1
    with pytest.raises(ValueError):
        N.training_input(None, vocabulary)
    with pytest.raises(ValueError):
        N.finetune_input()
    wrapped = N.finetune_input(splits={"train": train}).collect()
    assert all(r.language == "code" for r in wrapped)


def test_staged_tables_are_removed_after_a_build(spark, monkeypatch):
    paths = []
    original = B.work_path
    monkeypatch.setattr(B, "work_path", lambda s, label: paths.append(original(s, label)) or paths[-1])
    build(spark, code(spark, [("r", "a.py", "python", text(1))]))
    assert len(paths) == 3 and not any(path_exists(spark, p) for p in paths)


def test_incremental_build_finds_the_newest_version(spark):
    output = work_path(spark, "dataset")
    catalog = work_path(spark, "catalog")
    assert B.newest_version(stores.read_table(spark, catalog, "dataset_versions"), output) is None
    files = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(4)])
    first = B.incremental_build(files, output, "v1", stores.read_table(spark, catalog, "dataset_versions"))
    stores.write_table(first.version, catalog, "dataset_versions")
    versions = stores.read_table(spark, catalog, "dataset_versions")
    assert B.newest_version(versions, output).endswith("/v1")
    more = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(2, 7)])
    second = B.incremental_build(more, output, "v2", versions)
    assert second.metadata.first().total_samples == 7
    gone = versions.withColumn("path", F.lit(output + "/lost"))
    assert B.newest_version(gone, output).endswith("/v2")


def test_catalogue_snapshots(spark):
    base = work_path(spark, "catalog")
    assert stores.read_table(spark, base, "repositories").isEmpty()
    rows = K.conform(spark.createDataFrame([("1", "u", "n")], "id string, url string, name string"), "repositories")
    stores.write_table(rows, base, "repositories")
    again = stores.read_table(spark, base, "repositories")
    stores.write_table(again.unionByName(again.withColumn("id", F.lit("2"))), base, "repositories")
    assert sorted(r.id for r in stores.read_table(spark, base, "repositories").collect()) == ["1", "2"]


def test_ingest_into_a_living_store(spark):
    """A second ingest keeps other repositories, replaces its own, and takes a repeated url once."""
    raw = work_path(spark, "raw")

    def ingest(rows, requests, before=None):
        files = spark.createDataFrame(rows, "repo string, rel_path string, content string")
        asked = spark.createDataFrame(requests, "url string, repo string, branch string, error string")
        return I.ingest(asked, files, raw, *([before.repositories, before.catalog] if before else []))

    body = "\n".join(f"x{n} = {n}" for n in range(9))
    one = [("one", "a.py", body), ("one", "b.go", body)]
    first = ingest(one, [("https://h/one", "one", "main", None)])
    second = ingest([("t:wo", "c.py", body)], [("https://h/two", "t:wo", "main", None)] * 2, first)
    stored = stores.scan_raw_store(spark, raw)
    assert sorted((r.repo, r.rel_path) for r in stored.collect()) == [("one", "a.py"), ("t:wo", "c.py")]
    assert [(r.url, r.status) for r in second.repositories.orderBy("url").collect()] == [("https://h/one", "completed"), ("https://h/two", "completed")]
    assert second.catalog.count() == second.catalog.select("id").distinct().count() == 2
    assert all(path_exists(spark, r.local_path) for r in second.repositories.collect())
    ingest([("one", "d.go", body + "\n")], [("https://h/one", "one", "main", None)], second)
    assert sorted((r.repo, r.rel_path) for r in stores.scan_raw_store(spark, raw).collect()) == [("one", "d.go"), ("t:wo", "c.py")]
    with pytest.raises(ValueError, match="differ"):
        ingest(one, [("https://h/one", "one", "main", None), ("https://h/one", "one", "dev", None)])


def test_counts_beyond_four_bytes(spark):
    row = spark.createDataFrame([("v", 3_000_000_000)], "version string, total_samples long")
    assert K.conform(row, "dataset_versions").first().total_samples == 3_000_000_000


def test_a_build_reads_its_files_once(spark):
    files = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(5)] + [("r", "x.go", "go", "tiny")])
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    made = build(spark, files.mapInArrow(count, files.schema))
    assert reads.value == 6 and json.loads(made.metadata.first().languages) == {"go": 0, "python": 5}


def test_newest_dataset(spark):
    output = work_path(spark, "versions")
    files = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(30)])
    version = B.build_dataset(files, output, "v1").version
    splits, metadata = N.newest_dataset(version, output)
    assert set(splits) == {"train", "validation", "test"} and metadata.first().train_samples == splits["train"].count()
    with pytest.raises(ValueError, match="no dataset"):
        N.newest_dataset(version.limit(0), work_path(spark, "nothing"))


def test_the_shuffle_grows_with_the_stored_bytes(spark, monkeypatch):
    files = code(spark, [("r", f"{i}.py", "python", text(i)) for i in range(200)])
    asked = []
    original = B.shuffle
    monkeypatch.setattr(B, "shuffle", lambda df, **options: asked.append(options["partitions"]) or original(df, **options))
    build(spark, files)
    monkeypatch.setattr(B, "SHUFFLED_BYTES", 1024)
    build(spark, files)
    assert asked[0] == spark.sparkContext.defaultParallelism < asked[1]


def test_owners_of_one_name_stay_apart(spark):
    body, raw = "\n".join(f"a_{n} = {n}" for n in range(9)), work_path(spark, "raw")
    asked = spark.createDataFrame([("https://h/x/lib", "main", None), ("https://h/y/lib", "main", None)], "url string, branch string, error string")
    files = spark.createDataFrame(
        [("https://h/x/lib", "a.py", body), ("https://h/x/lib", "b.py", body + "\nb = 1"), ("https://h/y/lib", "a.py", body)],
        "url string, rel_path string, content string")
    made = I.ingest(asked, files, raw)
    assert {(r.url, r.name, r.files_count) for r in made.repositories.collect()} == {("https://h/x/lib", "lib", 2), ("https://h/y/lib", "lib", 1)}
    assert made.files.select("repo").distinct().count() == 2
    assert made.catalog.groupBy("repository_id").count().count() == 2
    shared = asked.withColumn("repo", F.lit("lib"))
    with pytest.raises(ValueError):
        I.ingest(shared, files.withColumn("repo", F.lit("lib")).drop("url"), work_path(spark, "raw"))
