"""Continuous ingestion and dataset growth with Structured Streaming.

Every micro-batch writes its own ``batch_id=N`` folder in overwrite mode and reads only earlier
ones, so a batch that is run again after a failure writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from millrace.functions.text import safe_name
from millrace.operators.files import dedupe_content, scan_files
from millrace.options import BuildOptions, ScanOptions
from millrace.plans.growth import (  # noqa: F401  (names of a stream's dataset)
    MERGE, SIZES, STREAM_SAMPLES, STREAM_VERSIONS, add_part, list_versions, read_version,
)
from millrace.schemas import CODE_FILES
from millrace.session import drop_path, stage, work_path
from millrace.sources.levels import FAN, KeyLevels

BATCH = T.StructField("batch_id", T.LongType())
STREAM_FILES = T.StructType([*CODE_FILES.fields, T.StructField("safe_name", T.StringType()), BATCH])
def _store(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def keys_path(store: str) -> str:
    """Where the keys of a store lie: beside it, so that readers of the store do not see them."""
    return f"{store}-keys"


def content_key() -> Column:
    """Uniform key of a content within its repo."""
    return F.sha2(F.concat_ws(":", "content_hash", "repo"), 256)


def stream_ingest(
    files: DataFrame, store: str, checkpoint: str, options: ScanOptions = ScanOptions(), fan: int = FAN
) -> DataStreamWriter:
    """Store arriving files; content already stored for the repo, or repeated in the batch, goes.

    A batch looks its keys up in the levelled store of keys, so it opens a bounded number of files however
    many batches there were, and none of the stored text. The stored keys are cut to the batch's keys
    first, so that the side joined against the store is never larger than one micro-batch.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        levels = KeyLevels(spark, keys_path(store), fan)
        levels.sweep(batch_id)
        arrived = dedupe_content(scan_files(batch, options)).withColumns({
            "safe_name": safe_name(F.col("rel_path")),
            "_key": content_key(),
        })
        staged = work_path(spark, "arrived")
        arrived = stage(arrived, "arrived", staged)
        try:
            keys = arrived.select("_key")
            known = levels.read(batch_id, MERGE).join(keys, F.col("key") == F.col("_key"), "left_semi")
            fresh = arrived.join(known, F.col("_key") == F.col("key"), "left_anti")
            _store(fresh.drop("_key").hint("rebalance"), store, batch_id)
        finally:
            drop_path(spark, staged)
        stored = spark.read.schema(STREAM_FILES).parquet(f"{store}/batch_id={batch_id}")
        levels.add(batch_id, stored.select(F.lit(MERGE).alias("kind"), content_key().alias("key")), stored.count())

    return (
        files.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def stream_dedupe_state(
    files: DataFrame, options: ScanOptions = ScanOptions(), arrival: str | None = None, within: str = "1 day"
) -> DataFrame:
    """The same dedupe held in the engine's state. State grows with distinct content; name an
    arrival time column to forget content after ``within``."""
    keys = ["repo", "content_hash"]
    if arrival is None:
        return scan_files(files, options).dropDuplicates(keys)
    timed = scan_files(files.withWatermark(arrival, within), options, carry=(arrival,))
    return timed.dropDuplicatesWithinWatermark(keys)


def stream_first_copies(
    files: DataFrame, arrival: str, within: str = "1 day", options: ScanOptions = ScanOptions()
) -> DataFrame:
    """One file for each content of a repo, that of the smallest path, as the batch dedupe gives it.

    Copies that arrive with gaps below ``within`` are one session of the content. When the watermark,
    ``within`` behind the newest arrival, has passed its end, the file is given out and its state dropped, so
    the state holds the content of the last sessions only. Content that returns later is given out again.
    """
    timed = scan_files(files.withWatermark(arrival, within), options, carry=(arrival,))
    columns = [c for c in timed.columns if c != arrival]
    session = F.session_window(arrival, within)
    least = F.min_by(F.struct(*columns), F.col("rel_path")).alias("file")
    return timed.groupBy("repo", "content_hash", session).agg(least).select("file.*")


def stream_dataset_build(
    files: DataFrame, output: str, checkpoint: str, options: BuildOptions = BuildOptions(), fan: int = FAN
) -> DataStreamWriter:
    """Each micro-batch adds its new samples and one version row, as ``growth.add_part`` does for a batch."""
    def add(batch: DataFrame, batch_id: int) -> None:
        add_part(batch, output, batch_id, options, fan)

    return (
        files.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
