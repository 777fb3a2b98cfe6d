"""The code_tree format against the scan by levels."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.options import ScanOptions
from millrace.sources import code_tree as C
from millrace.sources import tree as TR

BODY = "\n".join(f"line {i}" for i in range(9))


@pytest.fixture
def root(tmp_path):
    for path, text in {
        "r1/a.py": BODY, "r1/__init__.py": BODY, "r1/.hidden.py": BODY, "r1/deep/er/b.js": BODY, "r1/node_modules/c.js": BODY, "r1/short.py": "x",
        "r2/src/d.go": BODY, "r2/large.py": "x = 1\n" * 100_000, "r2/é ü.py": BODY, "r2/empty.py": "", "loose.py": BODY,
    }.items():
        place = tmp_path / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)
    os.symlink(tmp_path / "r1", tmp_path / "r2/link")
    (tmp_path / "r3").mkdir()
    return tmp_path


@pytest.mark.parametrize("slices", [1, 2, 64])
def test_equals_the_scan_by_levels(spark, root, slices):
    roots = spark.createDataFrame([(r, f"{root}/{r}") for r in ("r1", "r2", "r3")], "repo string, path string")
    C.register(spark)
    listed = spark.read.format("code_tree").option("slices", slices).load(str(root)).select("repo", "rel_path", "bytes", "content")
    want = TR.read_contents(TR.list_tree(roots).filter("NOT is_dir")).select("repo", "rel_path", "bytes", "content")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, want.collect()))
    got = C.read_code_tree(spark, f"file://{root}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, TR.scan_code_tree(roots).collect()))


def test_filters_are_tested_before_a_file_is_opened(spark, root):
    """Files that can't be read are left out when opened, so what a filter drops must not show."""
    C.register(spark)
    files = spark.read.format("code_tree").load(str(root))
    small = files.filter((F.col("bytes") <= 1000) & F.col("rel_path").endswith(".py") & (F.col("repo") == "r2"))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan code_tree" in plan and "Filter (" not in plan  # the source tests them all
    assert sorted(r.rel_path for r in small.collect()) == ["empty.py", "é ü.py"]
    reader = C._source()({"path": str(root)}).reader(None)
    from pyspark.sql.datasource import GreaterThan, IsNotNull, LessThanOrEqual, Not, StringContains

    left = list(reader.pushFilters([LessThanOrEqual(("bytes",), 1000), Not(StringContains(("rel_path",), "short")), IsNotNull(("bytes",)), GreaterThan(("content",), b"a")]))
    assert [type(f) for f in left] == [GreaterThan]
    opened = []
    import builtins
    real = builtins.open
    try:
        builtins.open = lambda path, *a, **k: opened.append(os.fsdecode(path)) or real(path, *a, **k)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        builtins.open = real
    assert not any("large" in p or "short" in p for p in opened) and len(rows) == len(opened) == 8


def test_one_repository_and_nothing(spark, root):
    C.register(spark)
    reader = spark.read.format("code_tree").option("repo", "mine").option("exclude", '["node_modules"]')
    assert sorted((r.repo, r.rel_path) for r in reader.load(f"{root}/r1").collect()) == [
        ("mine", p) for p in (".hidden.py", "__init__.py", "a.py", "deep/er/b.js", "short.py")]
    assert reader.load(f"{root}/r3").count() == 0 and reader.load(f"{root}/missing").count() == 0
    with pytest.raises(Exception):
        reader.load("s3://bucket/x").count()


def test_size_limit(spark, root):
    got = C.read_code_tree(spark, str(root), ScanOptions(max_size_kb=1000, min_lines=1))
    assert "large.py" in {r.rel_path for r in got.collect()}
