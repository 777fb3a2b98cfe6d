"""Versioned datasets out of the raw store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators.catalog import conform, latest_dataset, row_id
from millrace.operators.merge import merge_key, without_known
from millrace.operators.ordering import order_key, shuffle, split_bounds, split_label
from millrace.operators.samples import build_samples, language_counts, languages_json
from millrace.options import BuildOptions
from millrace.session import drop_path, path_bytes, path_exists, stage, work_path
from millrace.sources.stores import (
    read_samples_jsonl,
    version_directories,
    write_metadata,
    write_split_jsonl,
)

KEY = "split_key"
SHUFFLED_BYTES = 64 * 1024 * 1024  # stored bytes for each task of the shuffle
METADATA = ("version string, total_samples long, train_samples long, val_samples long, test_samples long, "
            "languages string, output_path string")


@dataclass
class BuildResult:
    dataset: DataFrame   # samples and split, as written
    metadata: DataFrame  # one row
    version: DataFrame   # one dataset_versions row


def build_dataset(
    files: DataFrame,
    output_dir: str,
    version: str,
    options: BuildOptions = BuildOptions(),
    existing: DataFrame | None = None,
    existing_bytes: int = 0,
) -> BuildResult:
    """Preprocess, merge, split, shuffle and write one version.

    ``files``: repo, rel_path, language, content. ``existing``: samples of an earlier version,
    for an incremental build. It is an error when the files give no sample at all, even if
    there are existing ones. ``existing_bytes``, the stored size of these, helps to size the shuffle.

    The files are read once: their languages are observed while samples are made. Samples are
    written to the shared folder once; the counts and the search for the two split
    bounds then read single columns of that table, and only the final write moves text again.
    The driver sees one row of bounds and one count per language. Rows are keyed on id and text:
    after an incremental build two of them may share an id, but never both.
    """
    spark = files.sparkSession
    path = f"{output_dir}/{version}"
    staged = [work_path(spark, label) for label in ("samples", "merged", "keys")]
    try:
        return _build(files, path, version, options, existing, existing_bytes, *staged)
    finally:
        for table in staged:
            drop_path(spark, table)


def _build(files, path, version, options, existing, existing_bytes, fresh_path, merged_path, keys_path) -> BuildResult:
    spark = files.sparkSession
    keyed_by = order_key(options.split.seed, "id", "text")
    seen = Observation("languages")
    watched = files.observe(seen, F.collect_set("language").alias("languages"))
    fresh = stage(build_samples(watched, options).withColumn(KEY, keyed_by), "samples", fresh_path)
    named = spark.createDataFrame([(name,) for name in seen.get["languages"]], "language string")
    languages = languages_json(language_counts(fresh.select("language"), named)).first()
    merged, keys = fresh, fresh.select(KEY)
    if existing is not None:
        if fresh.isEmpty():
            raise ValueError("the files give no samples")
        # keys of earlier samples are found in one pass; their text is read again for the last write only
        old = existing.select(merge_key(key=options.merge_key).alias("merge_key"), keyed_by.alias(KEY))
        old = stage(old, "keys", keys_path)
        added = stage(without_known(fresh, old.select("merge_key"), merge_key(key=options.merge_key)), "merged", merged_path)
        merged = existing.withColumn(KEY, keyed_by).unionByName(added)
        keys = old.select(KEY).unionByName(added.select(KEY))

    bounds = split_bounds(keys, KEY, options.split).first()
    if not bounds.total_samples:
        raise ValueError("the files give no samples")
    labelled = merged.withColumn("split", split_label(F.col(KEY), bounds))
    size = path_bytes(spark, fresh_path if existing is None else merged_path) + existing_bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // SHUFFLED_BYTES))
    write_split_jsonl(shuffle(labelled, key=KEY, partitions=tasks).drop(KEY), dataset_path(path))

    metadata = spark.createDataFrame([(
        version, bounds.total_samples, bounds.train_samples, bounds.validation_samples, bounds.test_samples,
        languages.languages, path,
    )], METADATA)
    write_metadata(metadata, f"{path}/metadata")
    written = spark.read.schema(METADATA).json(f"{path}/metadata")
    row = conform(
        written.withColumn("path", F.col("output_path")).withColumn("id", row_id("version", "path")),
        "dataset_versions",
    )
    dataset = spark.read.schema(labelled.drop(KEY).schema).json(dataset_path(path))
    return BuildResult(dataset, written, row)


def newest_version(versions: DataFrame, output_dir: str) -> str | None:
    """Path of the newest recorded version if it is there, else of the newest version folder."""
    spark = versions.sparkSession
    newest = versions.orderBy(F.desc("created_at"), F.desc("id")).limit(1).collect()
    checked = spark.createDataFrame(
        [(row.id, row.path, row.created_at, path_exists(spark, row.path)) for row in newest],
        "id string, path string, created_at timestamp, path_exists boolean",
    )
    found = latest_dataset(checked, version_directories(spark, output_dir)).first()
    return found.path if found else None


def incremental_build(
    files: DataFrame, output_dir: str, version: str, versions: DataFrame, options: BuildOptions = BuildOptions()
) -> BuildResult:
    """Build on top of the newest version, or from nothing when there is none."""
    latest = newest_version(versions, output_dir)
    existing = read_samples_jsonl(files.sparkSession, dataset_path(latest)) if latest else None
    size = path_bytes(files.sparkSession, dataset_path(latest)) if latest else 0
    return build_dataset(files, output_dir, version, options, existing, size)


def dataset_path(version_path: str) -> str:
    """Where a version keeps its splits."""
    return f"{version_path}/data"
