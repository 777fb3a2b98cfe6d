"""``spark.read.format("code_tree")``: folders of source files as a table of (repo, rel_path, bytes, content).

The folders directly in ``path`` are repositories, or, with the option ``repo``, the folder itself is one of that
name. The driver lists the uppermost levels until there are ``slices`` folders, 64 by default, and each becomes a
partition that walks what is below it; files above them are dealt into partitions too. Filters on repo, rel_path
and bytes are tested before a file is opened, so a size limit opens no large file. Folders whose relative
path contains one of the texts in ``exclude`` (a JSON list) are not entered. Links and what vanishes meanwhile
are left out; names that are no text are shown with their bytes escaped. The path is mounted on every executor.

``sources.tree`` lists in tasks, level by level, and reads other stores; this is for trees of which the upper
levels are small.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.files import admit, describe
from millrace.options import ScanOptions

NAME = "code_tree"
SCHEMA = "repo string, rel_path string, bytes long, content binary"
SLICES, BATCH_BYTES = 64, 16 << 20


def _source() -> type:
    """Made here so that tasks get the classes by value and need no copy of this package."""
    import base64
    import os

    import pyarrow as pa
    from pyspark.sql import datasource as D

    schema, name, slices, limit = SCHEMA, NAME, SLICES, BATCH_BYTES
    shape = pa.schema([("repo", pa.string()), ("rel_path", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])
    compare = {
        D.EqualTo: lambda x, v: x == v, D.LessThan: lambda x, v: x < v, D.LessThanOrEqual: lambda x, v: x <= v,
        D.GreaterThan: lambda x, v: x > v, D.GreaterThanOrEqual: lambda x, v: x >= v, D.In: lambda x, v: x in v,
        D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: lambda x, v: v in x,
    }

    class Slice(D.InputPartition):
        """Folders and files: (repo, relative path, place as base64 of its bytes)."""

        def __init__(self, folders: list, files: list):
            super().__init__((folders, files))
            self.folders, self.files = folders, files

    def entries(repo, below, place, exclude):
        """(is folder, repo, relative path, place) of what lies directly in a folder."""
        try:
            with os.scandir(base64.b64decode(place)) as found:
                for entry in found:
                    shown = entry.name.decode("utf-8", "backslashreplace")
                    if repo is None:
                        if entry.is_dir(follow_symlinks=False):
                            yield True, shown, "", base64.b64encode(entry.path).decode()
                        continue
                    path = f"{below}/{shown}" if below else shown
                    if entry.is_dir(follow_symlinks=False):
                        if not any(x in path for x in exclude):
                            yield True, repo, path, base64.b64encode(entry.path).decode()
                    elif entry.is_file(follow_symlinks=False):
                        yield False, repo, path, base64.b64encode(entry.path).decode()
        except OSError:  # gone meanwhile, or not to be read
            return

    class Reader(D.DataSourceReader):
        def __init__(self, options):
            path = options["path"]
            if "://" in path and not path.startswith("file:"):
                raise ValueError(f"not a mounted folder: {path}")
            self.root = base64.b64encode(os.fsencode(path.removeprefix("file://").removeprefix("file:"))).decode()
            self.repo, self.slices = options.get("repo"), int(options.get("slices", slices))
            self.exclude, self.tests = json.loads(options.get("exclude", "[]")), []

        def pushFilters(self, filters):
            for f in filters:
                inner, wanted = (f.child, False) if isinstance(f, D.Not) else (f, True)
                if type(inner) in compare and inner.attribute in (("repo",), ("rel_path",), ("bytes",)):
                    self.tests.append((type(inner), inner.attribute[0], inner.value, wanted))
                elif isinstance(inner, D.IsNotNull) and wanted and inner.attribute[0] != "content":
                    pass  # none of them is null
                else:
                    yield f

        def partitions(self):
            folders, files = [(self.repo, "", self.root)], []
            while folders and (len(folders) < self.slices or folders[0][0] is None):
                below = []
                for folder in folders:
                    for is_folder, *entry in entries(*folder, self.exclude):
                        (below if is_folder else files).append(tuple(entry))
                folders = below
            n = max(1, min(self.slices, len(folders) + len(files)))
            return [Slice(folders[i::n], files[i::n]) for i in range(n)]

        def passes(self, **row):
            return all(compare[kind](row[column], value) == wanted for kind, column, value, wanted in self.tests if column in row)

        def read(self, partition):
            rows, held = [], 0

            def batch():
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

            folders, files = list(partition.folders), list(partition.files)
            while folders or files:
                while files:
                    repo, path, place = files.pop()
                    if not self.passes(repo=repo, rel_path=path):
                        continue
                    try:
                        raw = base64.b64decode(place)
                        size = os.stat(raw).st_size
                        if not self.passes(bytes=size):
                            continue
                        with open(raw, "rb") as handle:
                            content = handle.read()
                    except OSError:
                        continue
                    rows.append((repo, path, size, content))
                    held += len(content)
                    if held >= limit or len(rows) >= 10_000:
                        yield batch()
                        rows, held = [], 0
                if folders:
                    for is_folder, *entry in entries(*folders.pop(), self.exclude):
                        (folders if is_folder else files).append(tuple(entry))
            if rows:
                yield batch()

    class CodeTree(D.DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return CodeTree


def register(spark: SparkSession) -> None:
    """Make the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source())


def read_code_tree(spark: SparkSession, path: str, options: ScanOptions = ScanOptions(), repo: str | None = None) -> DataFrame:
    """schemas.CODE_FILES for every admitted file below a mounted folder."""
    register(spark)
    prune = options.exclude if options.exclude_mode == "substring" else ()
    reader = spark.read.format(NAME).option("exclude", json.dumps(list(prune)))
    files = (reader.option("repo", repo) if repo else reader).load(path)
    small = files.filter(F.col("bytes") <= int(options.max_size_kb * 1024) + 1)  # reaches the source; the exact test follows
    return describe(admit(small, options), options)
