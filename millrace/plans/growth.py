"""Datasets that grow by immutable parts.

A version is a manifest: "all parts up to here" plus the two keys where validation and test begin. Adding to a
dataset writes the new samples and their narrow keys, and neither reads nor writes earlier text: the merge
looks new keys up in the levelled store of keys, and the exact bounds come from a summary, rows in each of 65,536
ranges of split keys, to which a part adds its own counts, and from the stored keys of the three ranges at most that
matter. One writer at a time; a part that is written again after a failure gives the same rows in the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.catalog import conform, row_id
from millrace.operators.merge import merge_key
from millrace.operators.ordering import add_sizes, bounds_at, bucket_sizes, in_buckets, order_key, split_edges, split_label
from millrace.operators.samples import build_samples, languages_json, version_label
from millrace.options import BuildOptions
from millrace.schemas import SAMPLES
from millrace.session import drop_path, list_directories, path_exists, stage, work_path
from millrace.sources.levels import FAN, KeyLevels
from millrace.sources.stores import SPLITS, write_split_jsonl

BATCH = T.StructField("batch_id", T.LongType())
STREAM_SAMPLES = T.StructType([
    *SAMPLES.fields, T.StructField("merge_key", T.StringType()), T.StructField("split_key", T.StringType()), BATCH,
])
STREAM_VERSIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("new_samples", T.LongType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("train_samples", T.LongType()),
    T.StructField("val_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("validation_from", T.StringType()),
    T.StructField("test_from", T.StringType()),
    T.StructField("languages", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    BATCH,
])
SIZES, EDGES = "bucket string, size long", "bucket string, first long, n long, validation_at long, test_at long"
COUNTS = "language string, samples long"
MERGE, SPLIT = "merge", "split"  # kinds of stored keys


def add_part(files: DataFrame, output: str, number: int, options: BuildOptions = BuildOptions(), fan: int = FAN) -> DataFrame:
    """Add the new samples of ``files`` (repo, rel_path, language, content) as part ``number``, and write the
    manifest of the version that ends with it, one row, which is returned."""
    spark = files.sparkSession
    levels = KeyLevels(spark, f"{output}/keys", fan)
    levels.sweep(number)
    fresh = build_samples(files, options).withColumns({
        "merge_key": F.sha2(merge_key("text", options.merge_key), 256),  # uniform, whatever makes samples the same
        "split_key": order_key(options.split.seed, "id", "text"),
    })
    part = f"{output}/samples/batch_id={number}"
    if number:
        staged = work_path(spark, "fresh")
        fresh = stage(fresh, "fresh", staged)
        try:
            keys = fresh.select("merge_key").distinct()
            known = levels.read(number, MERGE).join(keys, F.col("key") == F.col("merge_key"), "left_semi").distinct()
            fresh.join(known, F.col("merge_key") == F.col("key"), "left_anti").write.mode("overwrite").parquet(part)
        finally:
            drop_path(spark, staged)
    else:
        fresh.write.mode("overwrite").parquet(part)

    stored = spark.read.schema(STREAM_SAMPLES).parquet(part)
    n = stored.count()
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_key").alias("key")) for k in (MERGE, SPLIT)])
    levels.add(number, stored.select(F.inline(both)), 2 * n)
    sizes = _summed(spark, output, "sizes", SIZES, number, bucket_sizes(stored, "split_key"), "bucket", "size")
    counted = stored.groupBy("language").agg(F.count("*").alias("samples"))
    named = _summed(spark, output, "languages", COUNTS, number, counted, "language", "samples")
    edges = split_edges(sizes, options.split).collect()  # three rows at most
    near = levels.read(number + 1, SPLIT).filter(in_buckets("key", [e.bucket for e in edges]))
    bounds = bounds_at(near, "key", spark.createDataFrame(edges, EDGES))
    label = version_label(F.lit(output), F.lit(str(number)))
    row = bounds.select(
        row_id(label).alias("id"), label.alias("version"), F.lit(f"{output}/samples").alias("path"), F.lit(n).cast("long").alias("new_samples"),
        "total_samples", "train_samples", F.col("validation_samples").alias("val_samples"), "test_samples", "validation_from", "test_from",
        languages_json(named).select("languages").scalar().alias("languages"), F.current_timestamp().alias("created_at"),
    )
    return stage(row.coalesce(1), "manifest", f"{output}/versions/batch_id={number}")


def _summed(spark: SparkSession, output: str, name: str, schema: str, number: int, own: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of all parts so far: those up to the part before, and this one's."""
    path = f"{output}/{name}/batch_id="
    if number:
        own = spark.read.schema(schema).parquet(f"{path}{number - 1}").unionByName(own)
    total = own.groupBy(key).agg(F.sum(value).alias(value))
    return stage(total.coalesce(1), name, f"{path}{number}")


def list_versions(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(STREAM_VERSIONS).parquet(f"{output}/versions")


def read_version(spark: SparkSession, output: str, batch_id: int | None = None) -> DataFrame:
    """The samples of a version (default: the newest) with their split."""
    versions = list_versions(spark, output)
    chosen = versions if batch_id is None else versions.filter(F.col("batch_id") == batch_id)
    newest = chosen.orderBy(F.desc("batch_id")).limit(1)
    cut = newest.select(F.struct("batch_id", "validation_from", "test_from")).scalar()
    samples = spark.read.schema(STREAM_SAMPLES).parquet(f"{output}/samples")
    samples = samples.filter(F.col("batch_id") <= cut["batch_id"])
    return samples.withColumn("split", split_label(F.col("split_key"), cut)).drop("merge_key", "split_key")


@dataclass
class GrowthResult:
    dataset: DataFrame   # samples of the version and their split
    manifest: DataFrame  # one row: bounds, counts, languages
    version: DataFrame   # one dataset_versions row


def next_part(spark: SparkSession, output: str) -> int:
    """The number behind the last version that was written to its end."""
    found = [path for path, _ in list_directories(spark, f"{output}/versions") if path_exists(spark, f"{path}/_SUCCESS")]
    return max((int(path.rsplit("=", 1)[-1]) + 1 for path in found), default=0)


def grow_dataset(files: DataFrame, output: str, options: BuildOptions = BuildOptions(), fan: int = FAN) -> GrowthResult:
    """Add files to a dataset, or begin one. It is an error when the first files give no sample."""
    spark, number = files.sparkSession, next_part(files.sparkSession, output)
    manifest = add_part(files, output, number, options, fan)
    if not manifest.first().total_samples:
        raise ValueError("the files give no samples")
    return GrowthResult(read_version(spark, output, number), manifest, conform(manifest, "dataset_versions"))


def version_splits(spark: SparkSession, output: str, batch_id: int | None = None) -> dict[str, DataFrame]:
    """The splits of a version, as ``load_split_dataset`` gives those of stored files."""
    samples = read_version(spark, output, batch_id)
    return {s: samples.filter(F.col("split") == s).select(*SAMPLES.fieldNames()) for s in SPLITS}


def export_version(spark: SparkSession, output: str, path: str, batch_id: int | None = None) -> None:
    """A version as JSON lines by split, for readers that want files: the one step that writes all text."""
    write_split_jsonl(read_version(spark, output, batch_id).drop("batch_id"), path)
