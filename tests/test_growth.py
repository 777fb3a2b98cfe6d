"""Versions as manifests over parts."""

import pytest

from millrace.operators import merge as M
from millrace.operators import ordering as O
from millrace.operators import samples as S
from millrace.plans import growth as G
from millrace.session import path_exists, work_path
from millrace.sources.stores import load_split_dataset
from tests.test_streaming import SCHEMA, slices


def rows(df):
    return sorted((r.id, r.text, r.split) for r in df.select("id", "text", "split").collect())


def test_versions_grow_without_touching_earlier_text(spark):
    output, merged, made = work_path(spark, "grown"), None, []
    for n, part in enumerate(slices()):
        files = spark.createDataFrame(part, SCHEMA)
        made.append(G.grow_dataset(files, output, fan=2))
        fresh = S.build_samples(files)
        merged = fresh if merged is None else M.union_incremental(fresh, merged)
        want = O.exact_split(merged, "id", "text")
        assert rows(made[n].dataset) == rows(want)
        row = made[n].manifest.first()
        counts = O.split_counts(want).first()
        assert (row.total_samples, row.train_samples, row.val_samples, row.test_samples) == tuple(counts)
        assert row.languages == S.languages_json(merged.groupBy("language").count().withColumnRenamed("count", "samples")).first()[0]
        assert made[n].version.first().total_samples == counts.total_samples
    assert G.next_part(spark, output) == 3 and G.list_versions(spark, output).count() == 3
    assert G.read_version(spark, output, 0).count() == made[0].manifest.first().total_samples
    assert {s: d.count() for s, d in G.version_splits(spark, output).items()} == dict(zip(("train", "validation", "test"), tuple(counts)[1:]))
    again = G.add_part(spark.createDataFrame(slices()[2], SCHEMA), output, 2, fan=2)  # as after a failure
    assert again.first().total_samples == counts.total_samples and rows(G.read_version(spark, output)) == rows(want)
    G.export_version(spark, output, work_path(spark, "x") + "/data")


def test_adding_needs_no_text_of_earlier_parts(spark, monkeypatch):
    """The samples of the first part are unreadable while the second is added."""
    output = work_path(spark, "grown")
    G.grow_dataset(spark.createDataFrame(slices()[0], SCHEMA), output)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/samples/batch_id=0")
    system, away = hidden.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(f"{output}/away")
    assert system.rename(hidden, away)
    made = G.grow_dataset(spark.createDataFrame(slices()[2], SCHEMA), output)
    assert made.manifest.first().total_samples == 10 and not path_exists(spark, f"{output}/samples/batch_id=0")
    assert system.rename(away, hidden)
    assert G.read_version(spark, output).count() == 10


def test_export_gives_the_files_of_a_version(spark):
    output, out = work_path(spark, "grown"), work_path(spark, "files")
    made = G.grow_dataset(spark.createDataFrame(slices()[0], SCHEMA), output)
    G.export_version(spark, output, out)
    read = load_split_dataset(spark, out)
    assert sorted((r.id, s) for s, d in read.items() for r in d.collect()) == sorted((r.id, r.split) for r in made.dataset.collect())


def test_nothing_to_begin_with(spark):
    with pytest.raises(ValueError):
        G.grow_dataset(spark.createDataFrame([], SCHEMA), work_path(spark, "grown"))


def test_empty_part_changes_nothing(spark):
    output = work_path(spark, "grown")
    first = rows(G.grow_dataset(spark.createDataFrame(slices()[0], SCHEMA), output).dataset)
    made = G.grow_dataset(spark.createDataFrame([], SCHEMA), output)
    assert rows(made.dataset) == first and made.manifest.first().new_samples == 0
