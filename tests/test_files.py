import pytest
from pyspark.sql import functions as F

from millrace.operators import files as FI
from millrace.options import ScanOptions
from millrace.sources import stores, tree
from millrace.session import shared_dir, work_path

BODY = "a\nb\nc\nd\ne\n"


def raw(spark, rows):
    return spark.createDataFrame(rows, "repo string, rel_path string, content string")


def test_path_patterns_are_substrings(spark):
    paths = ["src/builder.py", ".github/a.py", "a/*.min.js", "a.min.js", "src/a.py", "redistribute/x.py"]
    kept = FI.exclude_paths(raw(spark, [("r", p, "") for p in paths]))
    assert sorted(r.rel_path for r in kept.collect()) == ["a.min.js", "src/a.py"]
    assert FI.exclude_paths(raw(spark, [("r", "dist/a", "")]), ()).count() == 1


def test_size_limit_is_inclusive(spark):
    sizes = spark.createDataFrame([(512_000,), (512_001,)], "bytes long")
    assert [r.bytes for r in FI.filter_size(sizes).collect()] == [512_000]


def test_scan_rules(spark):
    rows = [
        ("r", "a.PY", BODY), ("r", "b.py", "a\nb\nc\nd\n"), ("r", "c.md", BODY), ("r", "venv/d.py", BODY),
        ("r", "e.py", "x\r\n" * 5), ("r", "f.py", "x" * 600_000),
    ]
    found = {r.rel_path: r for r in FI.scan_files(raw(spark, rows)).collect()}
    assert set(found) == {"a.PY", "e.py"}
    assert found["a.PY"].language == "python" and found["a.PY"].extension == ".py"
    assert found["e.py"].content == "x\n" * 5 and found["e.py"].size_kb == 0.015  # bytes before decoding


def test_custom_extension_without_a_language_is_dropped(spark):
    options = ScanOptions(extensions=(".md", ".py"))
    assert [r.rel_path for r in FI.scan_files(raw(spark, [("r", "a.md", BODY), ("r", "a.py", BODY)]), options).collect()] == ["a.py"]


def test_dedupe_keeps_the_smallest_path_of_each_repo(spark):
    rows = [("r", "z.py", BODY), ("r", "b.py", BODY), ("s", "q.py", BODY), ("r", "c.py", BODY + "f")]
    kept = FI.dedupe_content(FI.scan_files(raw(spark, rows)))
    assert sorted((r.repo, r.rel_path) for r in kept.collect()) == [("r", "b.py"), ("r", "c.py"), ("s", "q.py")]


def test_dedupe_limits_groups_before_the_shuffle(spark):
    plan = FI.dedupe_content(FI.scan_files(raw(spark, [("r", "a.py", BODY)])))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_costly_columns_are_computed_once_and_not_pushed_below(spark):
    """The decoded text must not reappear in a filter below."""
    plan = FI.scan_files(raw(spark, [("r", "a.py", BODY)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("makeValid") == 1


def test_summary_adds_rounded_sizes(spark):
    rows = spark.createDataFrame([("r", 5, 0.1), ("r", 6, 0.2)], "repo string, line_count int, size_kb double")
    row = FI.repo_summary(rows).first()
    assert (row.files, row.lines, row.size_kb) == (2, 11, 0.3)


def test_tree_scan_finds_underscore_and_dot_names(spark, tmp_path):
    names = ["__init__.py", ".hidden.py", "a/b/c/deep.go", "dist/x.py", "a/_private/m.rs", "empty.py", "skip.md"]
    for name in names:
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_bytes(b"" if name == "empty.py" else (BODY + name).encode() + b"\xff")
    roots = spark.createDataFrame([("repo", str(tmp_path / "repo")), ("gone", str(tmp_path / "gone"))], "repo string, path string")
    found = {r.rel_path: r for r in tree.scan_code_tree(roots).collect()}
    assert set(found) == {"__init__.py", ".hidden.py", "a/b/c/deep.go", "a/_private/m.rs"}
    assert found["a/b/c/deep.go"].content == BODY + "a/b/c/deep.go�"
    folders = tree.list_tree(roots).filter("is_dir").select("rel_path")
    assert sorted(r.rel_path for r in folders.collect()) == ["a", "a/_private", "a/b", "a/b/c", "dist"]


def test_raw_store_round_trip(spark):
    files = FI.scan_files(raw(spark, [("r", "a/b.py", BODY), ("r", "a_b.py", BODY + "f"), ("s", "x.go", BODY)]))
    path = work_path(spark, "raw")
    stores.write_raw_store(files, path)
    stored = stores.scan_raw_store(spark, path)
    assert sorted((r.repo, r.language, r.rel_path, r.safe_name) for r in stored.collect()) == [
        ("r", "python", "a/b.py", "a_b.py"), ("r", "python", "a_b.py", "a_b.py"), ("s", "go", "x.go", "x.go")]
    pruned = stored.filter("repo = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in pruned
    assert path.startswith(shared_dir(spark))


def test_raw_store_with_repo_as_a_column(spark):
    files = FI.scan_files(raw(spark, [("r", "a.py", BODY), ("s", "x.go", BODY)]))
    path = work_path(spark, "raw")
    stores.write_raw_store(files, path, folders=("language",))
    stored = stores.scan_raw_store(spark, path)
    assert sorted((r.repo, r.language, r.content) for r in stored.collect()) == [("r", "python", BODY), ("s", "go", BODY)]


def test_exclusion_by_glob(spark):
    names = ["a.min.js", "src/b.min.js", "src/min.js", "dist/c.py", "src/distance.py", "venv/x/y.py", "a+b/c.py"]
    frame = spark.createDataFrame([(n,) for n in names], "rel_path string")
    kept = {r.rel_path for r in FI.exclude_paths(frame, ("*.min.js", "dist", "v?nv", "a+b"), "glob").collect()}
    assert kept == {"src/min.js", "src/distance.py"}
    with pytest.raises(ValueError):
        FI.exclude_paths(frame, ("x",), "other")
