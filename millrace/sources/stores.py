"""Raw store, dataset versions and catalogue snapshots on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import safe_name
from millrace.operators.catalog import empty_table
from millrace.schemas import CATALOG_TABLES, CODE_FILES, SAMPLES
from millrace.session import list_directories, path_exists, stage

SPLITS = ("train", "validation", "test")
RAW_STORE = T.StructType(
    [f for f in CODE_FILES.fields if f.name not in ("repo", "language")]
    + [T.StructField("safe_name", T.StringType()), T.StructField("repo", T.StringType()),
       T.StructField("language", T.StringType())]
)

WITH_BUCKET = T.StructType([*RAW_STORE.fields, T.StructField("bucket", T.IntegerType())])

FOLDERS = ("repo", "language")
BUCKETED = ("bucket", "language")  # for very many repositories
BUCKETS = 4096


def repo_bucket() -> F.Column:
    return F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int")


def _laid_out(files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    stored = files.withColumn("safe_name", safe_name(F.col("rel_path")))
    return stored.withColumn("bucket", repo_bucket()) if "bucket" in folders else stored


def _write_folders(stored: DataFrame, path: str, folders: tuple[str, ...], mode: str, overwrite: str = "static") -> None:
    order = dict.fromkeys([*folders, "repo"])
    writer = stored.hint("rebalance", *folders).sortWithinPartitions(*order).write.mode(mode)
    writer.option("partitionOverwriteMode", overwrite).partitionBy(*folders).parquet(path)


def write_raw_store(files: DataFrame, path: str, folders: tuple[str, ...] = FOLDERS, mode: str = "overwrite") -> None:
    """Parquet in folders by repo and language.

    The rebalance hint gathers a folder's rows so tasks do not each write a file to every
    folder, and lets Spark divide the rows of an oversized repo and join small ones. With very
    many repos give ``folders=BUCKETED`` or ``("language",)``: repo is then a column, sorted so that row groups
    of other repos are skipped.
    """
    _write_folders(_laid_out(files, folders), path, folders, mode)


def replace_repositories(files: DataFrame, path: str, repos: DataFrame, folders: tuple[str, ...] = FOLDERS) -> None:
    """Store the files of the given repositories; those of others stay where they are.

    One write and one commit, so that text is not staged and no folder has to be deleted afterwards. Every folder
    in which an asked repository had files is written anew; it gets a row without a path, which readers skip,
    so that it is replaced even if no file is left for it. By ``BUCKETED`` folders other repositories of a
    touched folder are written again beside the new ones. The layout of a store must not change.
    """
    spark = files.sparkSession
    if not path_exists(spark, path):
        return write_raw_store(files, path, folders)
    if folders not in (FOLDERS, BUCKETED):
        raise ValueError(f"repositories cannot be replaced in folders by {folders}")
    asked = repos.select("repo").distinct()
    stored = spark.read.schema(RAW_STORE if folders == FOLDERS else WITH_BUCKET).parquet(path)
    new = _laid_out(files, folders)
    if folders == FOLDERS:
        held = stored.select(*folders).distinct().join(asked, "repo", "left_semi")
    else:
        touched = F.broadcast(asked.select(repo_bucket().alias("bucket")).distinct())  # as many as there are buckets at most
        held = stored.join(touched, "bucket", "left_semi")
        # another language of a touched bucket is written again too: its folder may hold the repository
        new = new.unionByName(held.filter(F.col("rel_path").isNotNull()).join(asked, "repo", "left_anti"), allowMissingColumns=True)
        held = held.select(*folders).distinct()
    marks = stage(held, "folders")
    _write_folders(new.unionByName(marks, allowMissingColumns=True), path, folders, "overwrite", "dynamic")


#: characters that a folder of a partition value shows as % and two hex digits
_ESCAPED = "%\"#'*/:=?\\{}[]^"


def folder_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 or ord(c) == 127 else c for c in value)


def folder_column(name) -> F.Column:
    """The same for a column."""
    for c in _ESCAPED:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return name


def scan_raw_store(spark: SparkSession, path: str) -> DataFrame:
    """The language is the folder's, never detected again; filters on folders prune them."""
    stored = spark.read.schema(RAW_STORE).parquet(path).select(*RAW_STORE.fieldNames())
    return stored.filter(F.col("rel_path").isNotNull())  # the others mark a replaced folder


def write_split_jsonl(dataset: DataFrame, path: str) -> None:
    """JSON lines, one folder per split; text outside ASCII is kept as it is."""
    dataset.write.mode("overwrite").partitionBy("split").json(path)


def read_samples_jsonl(spark: SparkSession, path: str, schema: T.StructType = SAMPLES) -> DataFrame:
    """All samples of a version. Blank and broken lines are skipped; a sample without text is an
    error, raised where the text is read."""
    read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    text = F.coalesce("text", F.raise_error(F.lit("sample without text")))
    # the filter makes every read look at the text, a bare count as well
    return read.withColumn("text", text).filter(F.col("text").isNotNull()).select(*schema.fieldNames())


def load_split_dataset(spark: SparkSession, path: str, schema: T.StructType = SAMPLES) -> dict[str, DataFrame]:
    """Train is required; validation and test are there only if they were written."""
    present = [s for s in SPLITS if path_exists(spark, f"{path}/split={s}")]
    if "train" not in present:
        raise FileNotFoundError(f"no training split in {path}")
    return {s: read_samples_jsonl(spark, f"{path}/split={s}", schema) for s in present}


def write_metadata(metadata: DataFrame, path: str) -> None:
    """One row of JSON beside the splits."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def version_directories(spark: SparkSession, output_dir: str) -> DataFrame:
    """(path, modified_at) of the version folders, one row per dataset version."""
    rows = list_directories(spark, output_dir)
    found = spark.createDataFrame(rows, "path string, seconds double")
    return found.select("path", F.timestamp_millis((F.col("seconds") * 1000).cast("long")).alias("modified_at"))


def _snapshots(spark: SparkSession, base: str, table: str) -> list[tuple[int, str]]:
    """Complete snapshots of a catalogue table, oldest first."""
    folders = [path for path, _ in list_directories(spark, f"{base}/{table}")]
    done = [path for path in folders if path_exists(spark, f"{path}/_SUCCESS")]
    return sorted((int(path.rsplit("-", 1)[-1]), path) for path in done)


def read_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The newest snapshot of a catalogue table; empty before the first one."""
    found = _snapshots(spark, base, table)
    if not found:
        return empty_table(spark, table)
    return spark.read.schema(CATALOG_TABLES[table]).parquet(found[-1][1])


def write_table(rows: DataFrame, base: str, table: str) -> str:
    """Write a whole new snapshot beside the old ones, so that rows may be read while they are
    replaced and a failed write changes nothing. One writer at a time."""
    spark = rows.sparkSession
    found = _snapshots(spark, base, table)
    path = f"{base}/{table}/snapshot-{found[-1][0] + 1 if found else 0}"
    rows.select(*CATALOG_TABLES[table].fieldNames()).write.mode("overwrite").parquet(path)
    return path
