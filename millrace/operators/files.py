"""From raw files to filtered, described and deduplicated files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.constants import LANGUAGE_BY_EXTENSION
from millrace.functions import text as X
from millrace.options import ScanOptions


def exclude_paths(files: DataFrame, patterns=ScanOptions.exclude, mode: str = ScanOptions.exclude_mode) -> DataFrame:
    """Drop a file when any pattern occurs anywhere in its relative path (``substring``, so that a
    star stands for itself), or matches the path or a part of it (``glob``)."""
    if mode not in ("substring", "glob"):
        raise ValueError(f"unknown mode {mode!r}")
    if not patterns:
        return files
    if mode == "glob":
        hit = reduce(or_, [F.col("rel_path").rlike(_glob(p)) for p in patterns])
    else:
        hit = reduce(or_, [F.contains("rel_path", F.lit(p)) for p in patterns])
    return files.filter(~hit)


def _glob(pattern: str) -> str:
    """Whole parts of a path; a star stays inside its part."""
    wild = {"*": "[^/]*", "?": "[^/]"}
    return r"(?:\A|/)" + "".join(wild.get(c, rf"\x{{{ord(c):x}}}") for c in pattern) + r"(?:/|\z)"


def filter_extension(files: DataFrame, extensions=ScanOptions.extensions) -> DataFrame:
    return files.filter(X.file_extension(F.col("rel_path")).isin(*extensions))


def filter_size(files: DataFrame, max_size_kb: float = ScanOptions.max_size_kb) -> DataFrame:
    """Needs ``bytes``; runs before content is decoded."""
    return files.filter(X.size_kb(F.col("bytes")) <= max_size_kb)


def filter_min_lines(files: DataFrame, min_lines: int = ScanOptions.min_lines) -> DataFrame:
    return files.filter(F.col("line_count") >= min_lines)


def admit(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The tests that need only a path and a byte count."""
    files = exclude_paths(files, options.exclude, options.exclude_mode)
    files = filter_extension(files, options.extensions)
    return filter_size(files, options.max_size_kb)


def language_dimension(spark) -> DataFrame:
    """31 fixed rows, safe to broadcast."""
    return spark.createDataFrame(list(LANGUAGE_BY_EXTENSION.items()), "extension string, language string")


def language_lookup_join(files: DataFrame) -> DataFrame:
    """Inner join on ``extension``: files of unknown language go."""
    return files.join(F.broadcast(language_dimension(files.sparkSession)), "extension")


def describe(files: DataFrame, options: ScanOptions = ScanOptions(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Decode admitted files and add language, size, line count and hash.

    Input: repo, rel_path, bytes, content (binary or text). Output: schemas.CODE_FILES
    and the ``carry`` columns.
    """
    extension = X.file_extension(F.col("rel_path"))
    known = files.withColumns({
        "extension": extension,
        "language": X.detect_language(extension),
        "size_kb": F.bround(X.size_kb(F.col("bytes")), 3),
    }).filter(F.col("language").isNotNull())
    decoded = X.compute_once(known, content=X.decode_text(F.col("content")))
    counted = X.compute_once(decoded, line_count=X.line_count(F.col("content")))
    described = filter_min_lines(counted, options.min_lines)
    return described.select(
        "repo", "rel_path", "extension", "language", "content", "size_kb", "line_count",
        X.content_hash(F.col("content")).alias("content_hash"), *carry,
    )


def scan_files(files: DataFrame, options: ScanOptions = ScanOptions(), carry: tuple[str, ...] = ()) -> DataFrame:
    """All file-level rules over a table of (repo, rel_path, content)."""
    if "bytes" not in files.columns:
        files = files.withColumn("bytes", F.octet_length("content"))
    return describe(admit(files, options), options, carry)


def dedupe_content(files: DataFrame) -> DataFrame:
    """One file per content hash within a repo: the one with the smallest path.

    ``= 1`` lets Spark keep only the first row of each group before the shuffle too, so a hot
    hash sends at most one row per task.
    """
    order = Window.partitionBy("repo", "content_hash").orderBy("rel_path")
    ranked = files.withColumn("_copy", F.row_number().over(order))
    return ranked.filter(F.col("_copy") == 1).drop("_copy")


def repo_summary(files: DataFrame, *keys: str) -> DataFrame:
    """Files, lines and size per repo. Rounded sizes are added as decimals: exact in any order."""
    return files.groupBy(*(keys or ("repo",))).agg(
        F.count("*").alias("files"),
        F.sum("line_count").alias("lines"),
        F.sum(F.col("size_kb").cast("decimal(18,3)")).cast("double").alias("size_kb"),
    )
