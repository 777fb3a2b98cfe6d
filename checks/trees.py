"""Rows written out as plain files, to be scanned."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def write_tree(files: DataFrame, root: str) -> int:
    """Write (repo, rel_path, content) rows as plain files below ``root``; returns their number."""
    def write(batches: Iterator):
        import os

        import pandas as pd

        for batch in batches:
            for repo, rel_path, content in zip(batch["repo"], batch["rel_path"], batch["content"]):
                target = os.path.join(root, repo, rel_path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                data = content if isinstance(content, bytes) else content.encode("utf-8")
                with open(f"{target}.part", "wb") as handle:
                    handle.write(data)
                os.replace(f"{target}.part", target)
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select("repo", "rel_path", "content").mapInPandas(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def write_archives(files: DataFrame, root: str, per_archive: int = 50_000) -> DataFrame:
    """Write (repo, rel_path, content) rows as zip archives below ``root``, for trees of very many small files, each
    of which would take blocks of its own on a disk. Gives roots (repo, path) with a null repo: the top folders are the
    repos. What a repo has in one folder of its own stays in one archive, so no folder is listed twice; of rows with
    the same path one is kept, as a disk does."""
    def write(batches: Iterator):
        import itertools
        import os
        import zipfile

        import pandas as pd
        from pyspark import TaskContext

        def rows():
            for batch in batches:
                yield from zip(batch["repo"], batch["_top"], batch["rel_path"], batch["content"])

        below = itertools.groupby(rows(), lambda row: row[:2])
        for n in itertools.count():
            _, part = next(below, (None, None))
            if part is None:
                return
            os.makedirs(root, exist_ok=True)
            target = os.path.join(root, f"part-{TaskContext.get().partitionId():05d}-{n:05d}.zip")
            with zipfile.ZipFile(f"{target}.part", "w") as archive:
                while part is not None:
                    for repo, _, rel_path, content in part:
                        archive.writestr(zipfile.ZipInfo("/".join((repo, rel_path))), content)
                    _, part = next(below, (None, None)) if len(archive.filelist) < per_archive else (None, None)
            os.replace(f"{target}.part", target)
            yield pd.DataFrame({"repo": pd.Series([None], dtype=object), "path": [target]})

    group = ["repo", "_top"]
    dealt = files.select("repo", F.substring_index("rel_path", "/", 1).alias("_top"), "rel_path", "content").repartition(*group)
    once = dealt.dropDuplicates([*group, "rel_path"]).sortWithinPartitions(*group)
    return stage(once.mapInPandas(write, "repo string, path string"), "archives")


def mounted(path: str) -> str:
    """A ``file:`` location as the path tasks can open; other stores cannot be written this way."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"not a mounted folder: {path}")
    return path.removeprefix("file://").removeprefix("file:")
