"""Trees of very many small files, kept in archives."""

import os
import zipfile

from checks import trees
from checks.queries import run_tree
from millrace.session import shared_dir
from millrace.sources import trainer_state, tree

ROWS = [("r", "a/b/c.py", "one"), ("r", "a/d.py", "zwei ü"), ("r", "e.py", ""), ("s", "node_modules/x/y.js", "gone"), ("s", "f.go", "x" * 5000)]


def contents(spark, roots, *exclude):
    listing = tree.list_tree(roots, exclude)
    files = listing.filter("NOT is_dir")
    return listing, {(r.repo, r.rel_path): (r.bytes, bytes(r.content)) for r in tree.read_contents(files).collect()}


def test_archives_are_listed_as_the_folders_are(spark, tmp_path):
    files = spark.createDataFrame([*ROWS, ROWS[0]], "repo string, rel_path string, content string")
    trees.write_tree(files, str(tmp_path / "plain"))
    plain = spark.createDataFrame([(r, str(tmp_path / "plain" / r)) for r in ("r", "s")], "repo string, path string")
    packed = trees.write_archives(files, str(tmp_path / "packed"), per_archive=2)
    for exclude in ((), ("node_modules",)):
        (a, one), (b, two) = contents(spark, plain, *exclude), contents(spark, packed, *exclude)
        rows = [sorted(tuple(r) for r in x.select("repo", "rel_path", "is_dir", "bytes").collect()) for x in (a, b)]
        assert rows[0] == rows[1] and one == two and len(one) == 5 - len(exclude)


def test_archive_with_a_repo_of_its_own(spark, tmp_path):
    path = str(tmp_path / "odd.zip")
    with zipfile.ZipFile(path, "w") as made:
        made.writestr("a.py", b"early")
        made.writestr("a.py", b"late", zipfile.ZIP_DEFLATED)
        made.writestr("empty/", b"")
        made.writestr("b/c.py", b"\xff" * 9000, zipfile.ZIP_DEFLATED)
        made.writestr("b/d.py", b"unknown", zipfile.ZIP_BZIP2)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "folder.zip").mkdir()
    (tmp_path / "folder.zip" / "in.py").write_bytes(b"in")
    roots = [("own", path), ("broken", str(tmp_path / "broken.zip")), ("folder", str(tmp_path / "folder.zip")), (None, path)]
    listing, found = contents(spark, spark.createDataFrame(roots, "repo string, path string"))
    folders = {(r.repo, r.rel_path) for r in listing.filter("is_dir").collect()}
    assert folders == {("own", "empty"), ("own", "b")}
    assert found == {("own", "a.py"): (4, b"late"), ("own", "b/c.py"): (9000, b"\xff" * 9000), ("folder", "in.py"): (2, b"in"),
                     (None, "a.py"): (4, b"late"), ("b", "c.py"): (9000, b"\xff" * 9000)}


def test_runs_take_no_file_for_each_checkpoint(spark, tmp_path):
    made = [(r, s, "error" if s % 3 == 0 else "view", float(s)) for r in range(3) for s in range(100)]
    made = spark.createDataFrame(made, "user_id long, event_id long, event_type string, value double")
    made.write.parquet(str(tmp_path / "events.parquet"))

    def entries():
        return {os.path.join(top, f) for top, dirs, files in os.walk(shared_dir(spark).removeprefix("file://")) for f in [*dirs, *files]}

    before = entries()
    found = trainer_state.read_trainer_state(run_tree(spark, str(tmp_path)))
    assert {(r.run_id, r.step): r.loss for r in found.collect()} == {(str(r), s): 9.5 if s % 3 == 0 else float(s) for r in range(3) for s in range(100)}
    assert len(entries() - before) < 150  # 603 files and folders as plain ones
