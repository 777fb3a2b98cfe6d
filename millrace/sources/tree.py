"""Scanning trees of source files.

Spark's file sources skip names that start with ``_`` or ``.``, which would lose every
``__init__.py``. Directories are therefore listed by tasks, one level per round, and the files
that pass the path and size tests are read by tasks. A root is a path mounted on every executor or a
URL that pyarrow opens there (s3, gs, hdfs, file); a table of (repo, rel_path, content) needs none of
this. A name that is no text is shown with its bytes escaped, and what vanishes meanwhile is left out.

Very many small files are better kept in zip archives: on a disk each file and folder takes a block of its own.
A root that is a ``.zip`` file stands for what is in it; if its repo is null, its top folders are the
repos. One task lists an archive from its directory, and a file is read by its offset. A folder that several archives
name is listed for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.files import admit, describe
from millrace.options import ScanOptions
from millrace.session import stage, work_path

LISTING = "repo string, rel_path string, path string, is_dir boolean, bytes long"
CONTENT = "repo string, rel_path string, bytes long, content binary"
READ_BATCH_BYTES = 32 * 1024 * 1024
PARTITION_BYTES = 128 * 1024 * 1024
LARGEST_TASKS = 20_000  # beyond, tasks read more than 128 MB each
RAW_NAME = "raw-name:"  # a path whose bytes are no text, in base64
PACKED = "zip:"  # in an archive: zip:<offset>+<stored size>:<archive> of a file, zip:<archive>!/<name> of a folder


def _files() -> tuple[Callable, Callable, Callable]:
    """(entries of a folder, content of a file, members of an archive), for mounted paths and for URLs of
    other stores. Made here so that tasks get them by value and need no copy of this package."""
    def remote(path):
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        return store, inside, path.removesuffix(inside)

    def entries(path):
        if "://" in path:
            from pyarrow import fs

            store, inside, lead = remote(path)
            for info in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
                if info.type in (fs.FileType.File, fs.FileType.Directory):
                    yield info.base_name, lead + info.path, info.type == fs.FileType.Directory, info.size or 0
            return
        import base64
        import os

        raw = path.startswith(RAW_NAME)
        with os.scandir(base64.b64decode(path.removeprefix(RAW_NAME)) if raw else os.fsencode(path)) as found:
            for entry in found:
                try:
                    folder = entry.is_dir(follow_symlinks=False)
                    if not folder and not entry.is_file():
                        continue
                    size = 0 if folder else entry.stat().st_size
                except OSError:  # gone meanwhile
                    continue
                try:
                    shown = entry.path.decode("utf-8")
                except UnicodeDecodeError:
                    shown = RAW_NAME + base64.b64encode(entry.path).decode()
                yield entry.name.decode("utf-8", "backslashreplace"), shown, folder, size

    def opened(path):
        if "://" in path:
            store, inside, _ = remote(path)
            return store.open_input_file(inside)
        return open(path, "rb")

    def members(path):
        """None if the path is no zip archive; else (name, path, is it a folder, size) of all in it. A name that is
        there twice is the later one, and folders need no entry of their own."""
        import zipfile

        if not path.lower().endswith(".zip"):
            return None
        try:
            with opened(path) as handle, zipfile.ZipFile(handle) as archive:
                found = {info.filename.strip("/"): info for info in archive.infolist()}
        except (OSError, zipfile.BadZipFile):  # a folder, or broken
            return None
        rows, folders = [], set()
        for name, info in found.items():
            above = name if info.is_dir() else name.rpartition("/")[0]
            while above and above not in folders:
                folders.add(above)
                rows.append((above, f"{PACKED}{path}!/{above}", True, 0))
                above = above.rpartition("/")[0]
            if not info.is_dir():
                rows.append((name, f"{PACKED}{info.header_offset}+{info.compress_size}:{path}", False, info.file_size))
        return rows

    def unpacked(path):
        import struct
        import zlib

        place, _, archive = path.removeprefix(PACKED).partition(":")
        offset, size = map(int, place.split("+"))
        with opened(archive) as handle:
            handle.seek(offset)
            flags, method, name, extra = struct.unpack("<6xHH16xHH", handle.read(30))
            handle.seek(offset + 30 + name + extra)
            data = handle.read(size)
        if flags & 1 or method not in (0, 8):
            raise OSError(f"encrypted, or packed in an unknown way: {path}")
        try:
            return zlib.decompress(data, -15) if method else data
        except zlib.error as error:
            raise OSError(f"broken: {path}") from error

    def content(path):
        if path.startswith(PACKED):
            return unpacked(path)
        if "://" in path:
            store, inside, _ = remote(path)
            with store.open_input_stream(inside) as stream:
                return stream.read()
        if path.startswith(RAW_NAME):
            import base64

            path = base64.b64decode(path.removeprefix(RAW_NAME))
        with open(path, "rb") as handle:
            return handle.read()

    return entries, content, members


def _lister(exclude: tuple[str, ...]) -> Callable:
    entries, _, members = _files()

    def list_level(batches: Iterator):
        import pandas as pd

        columns = ["repo", "rel_path", "path", "is_dir", "bytes"]
        for batch in batches:
            for repo, rel_path, path in zip(batch["repo"], batch["rel_path"], batch["path"]):
                rows, packed = [], None if rel_path else members(path)
                try:
                    for name, place, folder, size in entries(path) if packed is None else packed:
                        owner, below = repo, f"{rel_path}/{name}" if rel_path else name
                        if packed is not None and repo is None and (folder or "/" in name):
                            owner, _, below = name.partition("/")
                            if not below:
                                continue
                        entered = below if folder else below.rpartition("/")[0] if packed is not None else ""
                        if any(p in entered for p in exclude):
                            continue
                        rows.append((owner, below, place, folder, size))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except OSError:
                    pass
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return list_level


def list_tree(roots: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All entries below ``roots`` (repo, path; folders or zip archives): repo, rel_path, path, is_dir, bytes. Folders whose
    relative path has one of the ``exclude`` texts are not entered: it is in all paths below, too.

    Each level is listed in parallel and written to the shared folder before the next one, so a
    single huge repository spreads over all tasks and nothing is listed twice. Only the test for
    "no folder left" reaches the driver.
    """
    spark = roots.sparkSession
    base = work_path(spark, "tree")
    level = 0
    frontier = roots.select("repo", F.lit("").alias("rel_path"), "path")
    while True:
        found = frontier.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_lister(exclude), LISTING)
        listed = stage(found, "level", f"{base}/level={level}")
        folders = listed.filter(F.col("is_dir") & ~F.startswith("path", F.lit(PACKED)))  # archives are listed whole
        frontier = folders.select("repo", "rel_path", "path")
        level += 1
        if frontier.isEmpty():
            return spark.read.schema(LISTING).option("basePath", base).parquet(
                *[f"{base}/level={i}" for i in range(level)]
            ).select("repo", "rel_path", "path", "is_dir", "bytes")


def read_contents(listing: DataFrame) -> DataFrame:
    """Read the listed files: repo, rel_path, bytes, content. Unreadable files are left out.

    Files are dealt round robin over tasks of about 128 MB, whatever folder they come from.
    """
    total = listing.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")).first().total
    floor = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(floor, min(LARGEST_TASKS, math.ceil(total / PARTITION_BYTES)))
    limit = READ_BATCH_BYTES
    _, content_of, _ = _files()

    def read(batches: Iterator):
        import pandas as pd

        def frame(rows):
            return pd.DataFrame(rows, columns=["repo", "rel_path", "bytes", "content"])

        for batch in batches:
            rows, held = [], 0
            for repo, rel_path, path, size in zip(batch["repo"], batch["rel_path"], batch["path"], batch["bytes"]):
                try:
                    content = content_of(path)
                except OSError:
                    continue
                rows.append((repo, rel_path, size, content))
                held += len(content)
                if held >= limit:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    chosen = listing.select("repo", "rel_path", "path", "bytes").repartition(tasks)
    return chosen.mapInPandas(read, CONTENT)


def scan_code_tree(roots: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """schemas.CODE_FILES for every admitted file; path and size tests run before any read."""
    prune = options.exclude if options.exclude_mode == "substring" else ()
    files = admit(list_tree(roots, tuple(prune)).filter("NOT is_dir"), options)
    return describe(read_contents(files), options)
