"""Replacing repositories in a raw store, in both layouts."""

import pytest

from millrace.operators import files as FI
from millrace.plans import ingest as I
from millrace.session import path_exists, work_path
from millrace.sources import stores

BODY = "\n".join(f"x{n} = {n}" for n in range(9))


def scanned(spark, rows):
    return FI.scan_files(spark.createDataFrame([(r, p, BODY + e) for r, p, e in rows], "repo string, rel_path string, content string"))


def names(spark, repos):
    return spark.createDataFrame([(r,) for r in repos], "repo string")


def held(spark, path):
    return sorted((r.repo, r.language, r.rel_path, r.content[len(BODY):]) for r in stores.scan_raw_store(spark, path).collect())


@pytest.mark.parametrize("folders", [stores.FOLDERS, stores.BUCKETED])
def test_replaced_repositories(spark, folders, monkeypatch):
    monkeypatch.setattr(stores, "BUCKETS", 2)  # repositories share folders
    path = work_path(spark, "raw")
    others = [(f"other{i}", "z.go", "") for i in range(6)] + [(f"other{i}", "z.py", "") for i in range(6)]
    before = [("a", "x.py", ""), ("a", "y.go", ""), ("b/c", "k.rs", ""), ("gone", "m.py", "")]
    stores.replace_repositories(scanned(spark, others + before), path, names(spark, ["a", "b/c", "gone"]), folders)
    untouched = [(r, "go" if p.endswith("go") else "python", p, e) for r, p, e in others]
    assert held(spark, path) == sorted(untouched + [("a", "go", "y.go", ""), ("a", "python", "x.py", ""), ("b/c", "rust", "k.rs", ""), ("gone", "python", "m.py", "")])

    again = [("a", "x.py", "!"), ("b/c", "n.java", ""), ("new", "o.go", "")]
    for _ in range(2):  # a repeated write changes nothing
        stores.replace_repositories(scanned(spark, again), path, names(spark, ["a", "b/c", "gone", "new", "never"]), folders)
        assert held(spark, path) == sorted(untouched + [("a", "python", "x.py", "!"), ("b/c", "java", "n.java", ""), ("new", "go", "o.go", "")])
    stores.replace_repositories(scanned(spark, []), path, names(spark, ["a", "b/c", "new"]), folders)
    assert held(spark, path) == sorted(untouched)


def test_text_is_written_once(spark):
    """A replacement stages folder names only."""
    path = work_path(spark, "raw")
    stores.write_raw_store(scanned(spark, [("a", "x.py", "")]), path)
    rows = spark.createDataFrame([("a", "x.py", BODY)], "repo string, rel_path string, content string")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    stores.replace_repositories(FI.scan_files(rows.mapInArrow(count, rows.schema)), path, names(spark, ["a"]))
    assert reads.value == 1 and len(held(spark, path)) == 1


def test_layouts_that_cannot_be_replaced(spark):
    path = work_path(spark, "raw")
    stores.write_raw_store(scanned(spark, [("a", "x.py", "")]), path, folders=("language",))
    with pytest.raises(ValueError, match="replaced"):
        stores.replace_repositories(scanned(spark, [("a", "x.py", "")]), path, names(spark, ["a"]), ("language",))


def test_ingest_into_buckets(spark):
    raw = work_path(spark, "raw")

    def ingest(rows, urls, before=None):
        files = spark.createDataFrame(rows, "url string, rel_path string, content string")
        asked = spark.createDataFrame([(u, "main", None) for u in urls], "url string, branch string, error string")
        return I.ingest(asked, files, raw, *([before.repositories, before.catalog] if before else []), folders=stores.BUCKETED)

    one, two = "https://h/me/name", "https://h/you/name"
    first = ingest([(one, "a.py", BODY), (two, "a.py", BODY)], [one, two])
    assert sorted((r.url, r.files) for r in first.summary.collect()) == [(one, 1), (two, 1)]
    second = ingest([(one, "b.py", BODY), (one, "c.go", BODY + "!")], [one], first)
    assert [(r.url, r.files) for r in second.summary.collect()] == [(one, 2)]
    assert sorted(r.rel_path for r in stores.scan_raw_store(spark, raw).collect()) == ["a.py", "b.py", "c.go"]
    assert all(path_exists(spark, r.local_path) for r in second.repositories.collect())
